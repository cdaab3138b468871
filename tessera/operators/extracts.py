"""Extracted rows: overlays, budgets, inferred formats, steady clocks and ranked picks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaid(rows: DataFrame, overlay: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Rows whose column takes the overlay's value, if there is one, by key without blanks and case; of equal keys the first by order counts."""
    bare = F.lower(F.regexp_replace(key, r"\s+", ""))
    first = overlay.where(F.col(column).isNotNull()).groupBy(bare.alias("_key")).agg(F.min_by(column, order).alias("_new"))
    return rows.withColumn("_key", bare).join(first, "_key", "left").withColumn(column, F.coalesce("_new", column)).drop("_key", "_new")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows in order as long as their sizes add up to the budget at most; the first of a group always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total, n = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(w)
    return rows.withColumns({"_total": total, "_n": n}).where((F.col("_total") <= budget) | (F.col("_n") == 1)).drop("_total", "_n")


def identifier_patterns(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, pattern): digits of one length, digits, or null if some value holds anything else."""
    size = F.length(value)
    one = F.concat(F.lit(r"\d{"), F.max(size), F.lit("}"))
    pattern = F.when(F.every(F.col(value).rlike(r"^\d+$")), F.when(F.min(size) == F.max(size), one).otherwise(r"\d+"))
    return rows.groupBy(*keys).agg(pattern.alias("pattern"))


def date_formats(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """(keys, format) of groups in which some n/n/yyyy has a part above 12: the first such date decides."""
    a, b = (F.regexp_extract(text, r"\b(\d{1,2})/(\d{1,2})/\d{4}\b", k).try_cast("int") for k in (1, 2))
    found = rows.withColumn("_format", F.when(a > 12, "d/M/yyyy").when(b > 12, "M/d/yyyy")).where("_format is not null")
    return found.groupBy(*keys).agg(F.min_by("_format", order).alias("format"))


def steady_clock(rows: DataFrame, keys: list[str], order: str, at: str, name: str) -> DataFrame:
    """Rows with a time that always grows: the row's own, or one more than the row before if that is later.

    By induction this is n plus the greatest of (time - n) so far, n being the place in the group.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    placed = rows.withColumn("_n", F.row_number().over(w))
    return placed.withColumn(name, F.max(F.col(at) - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")).drop("_n")


def first_two(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, first, second): the first two values of each group in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    few = rows.withColumn("_n", n).where("_n <= 2")
    return few.groupBy(*keys).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("_n") == 2, F.col(value))).alias("second"))


def captured(text: Column, pattern: str) -> Column:
    """What the pattern's first group holds, or all of the match if it has no group; null without a match."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def label_like(text: Column) -> Column:
    """3 to 60 characters with a letter among them, that are no number."""
    bare = F.trim(text)
    return F.length(bare).between(3, 60) & bare.rlike("[A-Za-z]")


def sentence_like(text: Column) -> Column:
    """Ends like a sentence, has over four words and no colon, or an address in it: no label for a fingerprint."""
    bare = F.trim(text)
    long = (F.size(F.split(bare, " +")) > 4) & ~bare.contains(":")
    return bare.endswith(".") | bare.endswith("?") | long | bare.contains("@")


def rate_text(rate: Column) -> Column:
    """A rate with at most 4 decimals, without zeros at the end."""
    return F.regexp_replace(rate.cast("decimal(10,4)").cast("string"), r"\.?0+$", "")
