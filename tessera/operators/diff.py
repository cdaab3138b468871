"""Multiset difference of row sets, and scores made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with _copy: 1, 2, ... among rows of one key, so that duplicates match one to one."""
    return rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def missing(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Expected keys beyond the actual ones, duplicates kept."""
    return expected.select(*key).exceptAll(actual.select(*key))


def counts(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """One row: expected, actual, matched; a key counts as often as both sides have it."""
    both = expected.select(*key, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(actual.select(*key, F.lit(0).alias("_e"), F.lit(1).alias("_a")))
    per_key = both.groupBy(*key).agg(F.sum("_e").alias("_expected"), F.sum("_a").alias("_actual"))
    return per_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in ((F.col("_expected"), "expected"), (F.col("_actual"), "actual"), (F.least("_expected", "_actual"), "matched"))])


def scores(one: DataFrame) -> DataFrame:
    """precision, recall and f1 (4 decimals) of counts(); nothing expected and nothing found is perfect."""
    empty = (F.col("expected") == 0) & (F.col("actual") == 0)
    ratio = lambda a, b: F.when(empty, 1.0).when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))
    p, r = ratio(F.col("matched"), F.col("actual")), ratio(F.col("matched"), F.col("expected"))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.when(p + r != 0, p + r))
    return one.select("expected", "actual", "matched", *[F.round(v, 4).alias(n) for v, n in ((p, "precision"), (r, "recall"), (f1, "f1"))])


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return numbered(rows, key, order).where("_copy = 1").drop("_copy")


def cell_summary(pairs: DataFrame, columns: list[str], seq: Column) -> DataFrame:
    """(column, n, example) of pairs with columns expected_c and actual_c: how many differ and the first expected value that does."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"expected_{c}").cast("string").alias("e"), F.col(f"actual_{c}").cast("string").alias("a")) for c in columns]))
    flat = pairs.select(seq.alias("seq"), cells.alias("x")).select("seq", "x.*").where(~F.col("e").eqNullSafe(F.col("a")))
    return flat.groupBy("column").agg(F.count("*").alias("n"), F.min_by("e", "seq").alias("example"))
