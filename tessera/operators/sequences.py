"""Ordered rows: spans, groups, carries, islands and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(rows: DataFrame, keys: list[str], order: list[str], start: Column, end: Column, *, inclusive: bool = True) -> DataFrame:
    """Rows within spans, with span 1, 2, ...: a start opens one (and closes the one before), an end closes it.

    An open tail is kept; rows outside are dropped; the end row belongs to its span if inclusive.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("span", F.coalesce(F.sum(start.cast("int")).over(so_far), F.lit(0)).cast("long")).where("span > 0")
    inner = Window.partitionBy(*keys, "span").orderBy(*order)
    ends = F.coalesce(F.sum((end & ~start).cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, -1 if inclusive else 0)), F.lit(0))
    return out.withColumn("_ends", ends).where("_ends = 0").drop("_ends")


def transition_groups(rows: DataFrame, keys: list[str], order: list[str], start: Column) -> DataFrame:
    """Rows with group 1, 2, ...: each start row begins one; rows before the first are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group", F.sum(start.cast("int")).over(w).cast("long")).where("group > 0")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, *, reset: Column | None = None) -> DataFrame:
    """Rows with the last non-null value at or before them, forgotten at reset rows."""
    by = Window.partitionBy(*keys).orderBy(*order)
    if reset is None:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(by))
    cut = rows.withColumn("_era", F.sum(reset.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_era").orderBy(*order))).drop("_era")


def islands(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, first, last, n): runs of consecutive whole numbers; rows of one number count once."""
    one = rows.select(*keys, number).distinct()
    base = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return one.withColumn("_base", base).groupBy(*keys, "_base").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_base")


def dense_islands(counts: DataFrame, keys: list[str], number: str, n: str) -> DataFrame:
    """Islands of the numbers whose count is at least max(2, a quarter of the peak)."""
    peak = F.max(n).over(Window.partitionBy(*keys))
    return islands(counts.withColumn("_peak", peak).where(F.col(n) >= F.greatest(F.lit(2), F.floor(F.col("_peak") * 0.25))), keys, number)


def runs(rows: DataFrame, keys: list[str], order: str, signature: str, *, share: float = 0.6) -> DataFrame:
    """Rows with run 1, 2, ...: the next number with a signature that overlaps the one before by `share` of the smaller goes on."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, sig = F.lag(signature).over(w), F.col(signature)
    goes_on = (F.lag(order).over(w) == F.col(order) - 1) & (F.size(F.array_intersect(sig, before)) >= share * F.least(F.size(sig), F.size(before)))
    breaks = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_break", breaks).withColumn("run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_break")


def gap_clusters(rows: DataFrame, keys: list[str], value: str, gap: float, ties: list[str] = ()) -> DataFrame:
    """Rows with cluster 1, 2, ... along value; a step of more than gap begins a new one."""
    w = Window.partitionBy(*keys).orderBy(value, *ties)
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("cluster", (F.sum("_new").over(w) + 1).cast("long")).drop("_new")


def halves(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with half a or b; a has max(1, n div 2) rows."""
    w = Window.partitionBy(*keys)
    a = F.row_number().over(w.orderBy(*order)) <= F.greatest(F.lit(1), F.expr("count(*) over (partition by " + ", ".join(keys) + ") div 2"))
    return rows.withColumn("half", F.when(a, "a").otherwise("b"))
