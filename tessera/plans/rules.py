"""Row rules: ordered classifiers and region markers, compiled to columns."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def row_matches(where: Mapping[str, Any], text: Column, cells: Column | None = None) -> Column:
    """All conditions of a rule: row_text pattern, exclude pattern, min_cells, min_length."""
    out = F.lit(True)
    if "row_text" in where:
        out = out & t.matches(text, where["row_text"])
    if "exclude" in where:
        out = out & ~t.matches(text, where["exclude"])
    if "min_length" in where:
        out = out & (F.length(text) >= where["min_length"])
    if "min_cells" in where and cells is not None:
        out = out & (F.size(cells) >= where["min_cells"])
    return out


def classified(rules: list[tuple[str, Mapping[str, Any]]], text: Column, cells: Column | None = None, default: str = "detail") -> Column:
    """The role of the first rule that matches."""
    out = None
    for role, where in rules:
        hit = row_matches(where, text, cells)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return F.lit(default) if out is None else out.otherwise(default)


def state_before(rows: DataFrame, keys: list[str], order: list[str], start: Column, end: Column, *, opened: bool = False) -> DataFrame:
    """Rows with _in, 1 within markers: outside, a start opens; inside, an end closes, tested first.

    A row that is both toggles the state, so the state before a row is that of the last row that is one
    of them only, turned by the number of toggles since.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    both = start & end
    marked = rows.withColumns({"_only": F.when(both, None).when(start, 1).when(end, 0), "_both": both.cast("int")})
    marked = marked.withColumn("_toggles", F.coalesce(F.sum("_both").over(before), F.lit(0)))
    # toggles up to the last pure marker, seen from this row
    marked = marked.withColumn("_at", F.when(F.col("_only").isNotNull(), F.col("_toggles")))
    last, at = F.last("_only", ignorenulls=True).over(before), F.last("_at", ignorenulls=True).over(before)
    state = F.pmod(F.coalesce(last, F.lit(int(opened))) + F.col("_toggles") - F.coalesce(at, F.lit(0)), F.lit(2))
    return marked.withColumn("_in", state).drop("_only", "_both", "_toggles", "_at")


def in_region(rows: DataFrame, keys: list[str], order: list[str], start: Column, end: Column) -> DataFrame:
    """Rows between markers by state_before(); rows with an end marker are not part of the region."""
    return state_before(rows, keys, order, start, end).where((F.col("_in") == 1) & ~end).drop("_in")
