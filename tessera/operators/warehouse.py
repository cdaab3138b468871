"""The operational warehouse: costs, volumes, facets and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_summary(costs: DataFrame, by: list[str], cost: str = "cost") -> DataFrame:
    return costs.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(cost).cast("decimal(18,2)").alias("total_cost"))


def bucket(call_type: Column, source: Column) -> Column:
    """Purpose of a call: training and classification by type, of unknown types by their intake's source."""
    return F.when(call_type.isin("training", "authoring"), "training").when(call_type == "classification", "classification").when(source == "training", "training").otherwise("production")


def by_day(rows: DataFrame, at: str) -> DataFrame:
    return rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def by_month_filled(rows: DataFrame, at: str, value: str) -> DataFrame:
    """(month, n, total) of all months from the first to the last there is, 0 where there are no rows."""
    month = F.trunc(F.to_date(at), "month")
    sums = rows.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.sum(value).cast("decimal(18,2)").alias("total"))
    months = sums.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return months.join(sums, "month", "left").select("month", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("total", F.lit(0)).cast("decimal(18,2)").alias("total"))


def facets(rows: DataFrame, filters: dict[str, Column], facet: str) -> DataFrame:
    """Counts by facet with all filters but the facet's own."""
    for name, condition in filters.items():
        if name != facet:
            rows = rows.where(condition)
    return rows.groupBy(facet).agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """One page of a listing; a plain sort with limit and offset, so only a page reaches the driver."""
    return rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def stats(jobs: DataFrame, status: str, reconciled: str) -> DataFrame:
    """One row: totals, completion and reconciliation percentages (1 decimal); unscored jobs count in neither."""
    n, done = F.count("*"), F.count_if(F.col(status).startswith("completed"))
    scored, ok = F.count(reconciled), F.count_if(F.col(reconciled))
    pct = lambda a, b: F.when(b > 0, F.round(100.0 * a / F.when(b > 0, b), 1)).otherwise(0.0)
    return jobs.agg(n.alias("total"), done.alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"), pct(done, n).alias("completion_pct"), pct(ok, scored).alias("reconciled_pct"))


def representatives(rows: DataFrame, shape: Column, order: list[str], k: int) -> DataFrame:
    """k rows, round-robin over their shapes in order of the shapes' first rows."""
    shaped = rows.withColumn("_shape", shape)
    first = shaped.groupBy("_shape").agg(F.min(F.struct(*order)).alias("_first"))
    turn = shaped.withColumn("turn", F.row_number().over(Window.partitionBy("_shape").orderBy(*order)))
    return turn.where(F.col("turn") <= k).join(first, "_shape").orderBy("turn", "_first").limit(k).drop("_shape", "_first")
