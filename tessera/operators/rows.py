"""Rows within groups: footers, continuations, open items, tiers, grades and upkeep of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def anchored(sums: DataFrame, net: str, subtotal: str, threshold: float = 0.01) -> DataFrame:
    """Net sum against the stated subtotal: variance, variance_pct and ok; a subtotal of 0 has no percentage."""
    variance = (F.col(net) - F.col(subtotal)).cast(MONEY)
    pct = F.when(F.col(subtotal) == 0, 0.0).otherwise(F.abs(variance.cast("double")) / F.abs(F.when(F.col(subtotal) != 0, F.col(subtotal).cast("double"))))
    return sums.withColumns({"variance": variance, "variance_pct": pct}).withColumn("ok", F.col("variance_pct") <= threshold)


def accumulated(rows: DataFrame, keys: list[str], order: list[str], is_item: Column, value: Column, name: str) -> DataFrame:
    """Item rows with the sum of the values of rows after them, up to the next item; values before the first item are lost."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"_item": F.sum(is_item.cast("int")).over(w), "_is": is_item})
    total = F.sum(F.when(~F.col("_is"), value)).over(Window.partitionBy(*keys, "_item"))
    return marked.withColumn(name, F.coalesce(total, F.lit(0)).cast(MONEY)).where("_is").drop("_item", "_is")


def footers(rows: DataFrame, keys: list[str], order: str, tiers: list[Column]) -> DataFrame:
    """Per group the last row of the first tier that has any."""
    tier = F.coalesce(*[F.when(c, F.lit(k)) for k, c in enumerate(tiers)])
    w = Window.partitionBy(*keys).orderBy("_tier", F.col(order).desc())
    return rows.withColumn("_tier", tier).where("_tier is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_tier", "_n")


def continuations(rows: DataFrame, keys: list[str], order: str, head: Column, stop: Column) -> DataFrame:
    """Rows that follow a head row without a stop between them."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumns({"_head": head.cast("int"), "_stop": stop.cast("int")}).withColumn("_block", F.sum("_head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stops = F.sum(F.when(F.col("_head") == 0, F.col("_stop")).otherwise(0)).over(Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_stops", stops).where("_block > 0 and _head = 0 and _stops = 0").drop("_head", "_stop", "_block", "_stops")


def consistent(rows: DataFrame, keys: list[str], rate: Column, places: int = 4) -> DataFrame:
    """(keys, rate): the rate if all rows of the group have the same, to `places` decimals, else null."""
    r = F.round(rate, places)
    return rows.groupBy(*keys).agg(F.when(F.min(r) == F.max(r), F.min(r)).alias("rate"))


def grades(samples: DataFrame, keys: list[str], score: Column, required: int = 2) -> DataFrame:
    """(keys, grade, samples, approvable): verified if all samples reproduce, review if any does, else failed."""
    all_ok, any_ok, n = F.every(score >= 1), F.some(score >= 1), F.count("*")
    return samples.groupBy(*keys).agg(F.when(all_ok, "verified").when(any_ok, "review").otherwise("failed").alias("grade"), n.alias("samples"), (all_ok & (n >= required)).alias("approvable"))


def kept_runs(runs: DataFrame, order: str, most: int) -> DataFrame:
    """The newest `most` runs, a bounded sort."""
    return runs.orderBy(F.col(order).desc()).limit(most)


def swept(rows: DataFrame, status: str, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows of which those still running after `seconds` are failed."""
    old = (F.col(status) == "running") & (F.unix_timestamp(now) - F.unix_timestamp(at) > seconds)
    return rows.withColumn(status, F.when(old, "failed").otherwise(F.col(status)))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without the keys of the new ones, and the new ones."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def nearest(rows: DataFrame, value: str, centres: list[tuple[str, float]]) -> Column:
    """The name of the nearest of a few centres, the first of equals."""
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(value) - c).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, c) in enumerate(centres)]))
    return best["n"]
