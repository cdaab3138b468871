"""Orders, top rows and choices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the words by which a text is safe as a marker.
LETTERS = "A-Za-zÀ-ÿ"


def extreme(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is first in the order, which must tell all rows of a key apart."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def occurrence(rows: DataFrame, keys: list[str], order: str, value: str, when: Column, *, last: bool = False) -> DataFrame:
    """(keys, value): the value of the first or last row that meets a condition."""
    pick = F.max_by if last else F.min_by
    return rows.where(when).groupBy(*keys).agg(pick(value, order).alias(value))


def by_tiers(rows: DataFrame, keys: list[str], tiers: list[Column], order: list[Column], most: int) -> DataFrame:
    """Of each key the first `most` rows: those of the first tier that holds for them go first, within a tier by the order."""
    tier = F.coalesce(*[F.when(t, F.lit(k)) for k, t in enumerate(tiers)], F.lit(len(tiers)))
    w = Window.partitionBy(*keys).orderBy("_tier", *order)
    return rows.withColumn("_tier", tier).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).drop("_tier")


def capped(rows: DataFrame, keys: list[str], newest: Column, size: Column, most: int) -> DataFrame:
    """Of each key the newest row, then the largest others, `most` in all."""
    first = Window.partitionBy(*keys).orderBy(newest.desc())
    marked = rows.withColumn("_new", F.row_number().over(first) == 1)
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), size.desc(), newest.desc())
    return marked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_new", "_n")


def _fitting(budget: int, key: str):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("rank").to_pylist(), table.column("size").to_pylist(), range(table.num_rows), strict=True))
        left, kept = budget, []
        for _, size, k in rows:
            if size <= left:
                left -= size
                kept.append(k)
        return table.take(pa.array(sorted(kept), pa.int64()))

    return run


def fitting(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """Rows (key, rank, size, ...) of each key that fit into a budget, taken by rank; one that is too large is passed over and later ones are still tried.

    What is left depends on every choice before, which windows cannot say; a group is one document's rows.
    """
    return rows.groupBy(key).applyInArrow(_fitting(budget, key), rows.schema)


def lineage(versions: DataFrame, key: str, version: str, status: str) -> DataFrame:
    """Versions with place 1, 2, ... from the newest, and live for the first approved one."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    approved = F.sum((F.col(status) == "approved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return versions.withColumns({"place": F.row_number().over(w).cast("long"), "live": (F.col(status) == "approved") & (approved == 1)})


def regressions(compared: DataFrame, key: str) -> DataFrame:
    """Compared runs (key, before, after, outcome) with their place: the worst outcomes first, then the largest loss, then the key."""
    order = ("regressed", "missing", "unscored", "new", "unchanged", "improved")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("outcome"))
    loss = F.coalesce(F.col("after") - F.col("before"), F.lit(0))
    return compared.withColumn("place", F.row_number().over(Window.orderBy(rank, loss, key)).cast("long"))


def merged_order(rows: DataFrame, doc: str, page: Column, row: Column, tie: list[str]) -> DataFrame:
    """Rows with place 1, 2, ... in a document by the page and row that they name; those without a row stand at the page's end, those without a page last."""
    w = Window.partitionBy(doc).orderBy(page.asc_nulls_last(), row.asc_nulls_last(), *tie)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def first_distinct(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys, as several regions give them, the first."""
    return extreme(rows, keys, order)


def split_holdout(rows: DataFrame, item: str, holdout: Column, primary: Column) -> DataFrame:
    """Rows with part: holdout wins, but a primary row is never held out."""
    return rows.withColumn("part", F.when(primary, "train").when(holdout, "holdout").otherwise("train"))


def overlap_ratio(a: Column, b: Column) -> Column:
    """How much of the smaller of two arrays' distinct values the other has; 0 for an empty one."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def headings(rows: DataFrame, keys: list[str], order: str, text: str, preferred: tuple[str, ...], *, letters: str = LETTERS) -> DataFrame:
    """(keys, heading): the first row with a preferred word, by the words' order, else the first that is safe as a marker."""
    low = F.lower(F.col(text))
    tier = F.coalesce(*[F.when(low.contains(w), F.lit(k)) for k, w in enumerate(preferred)], F.when(safe_marker(F.col(text), letters), F.lit(len(preferred))))
    return rows.withColumn("_tier", tier).where("_tier is not null").groupBy(*keys).agg(F.min_by(text, F.struct("_tier", order)).alias("heading"))


def safe_marker(text: Column, letters: str = LETTERS) -> Column:
    """Whether a text may serve as a marker: no four digits in a row, no date, and two words of three letters."""
    return ~text.rlike(r"\d{4,}|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}") & (F.size(F.regexp_extract_all(text, F.lit(f"([{letters}]{{3,}})"), F.lit(1))) >= 2)
