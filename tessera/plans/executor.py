"""Extraction plans: rows selected by region and pattern, values by expressions in order, sums and checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.amounts import MONEY
from ..operators import grouping
from .expressions import plan_expression


@dataclass(frozen=True)
class Plan:
    """Markers are comma-separated; without start markers all rows are selected.  Checks are (name, left, right, tolerance)."""

    start: str = ""
    end: str = ""
    first_only: bool = False
    max_pages: int | None = None
    include: str | None = None
    exclude: tuple[str, ...] = ()
    row_rules: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    checks: tuple[tuple[str, Mapping[str, Any], Mapping[str, Any], float], ...] = ()


KEYS, ORDER = ["doc_id"], ["page", "row_index"]


def selected(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows of the plan's region, once each, that no exclude pattern and the include pattern match."""
    text = F.col("text")
    if plan.start:
        rows = grouping.plan_region(rows, KEYS, ORDER, "page", t.has_any(text, plan.start), t.has_any(text, plan.end), first_only=plan.first_only, max_pages=plan.max_pages)
    keep = ~reduce(lambda a, b: a | b, [t.matches(text, p) for p in plan.exclude], F.lit(False))
    return rows.where(keep & (t.matches(text, plan.include) if plan.include else F.lit(True)))


def execute(rows: DataFrame, plan: Plan) -> DataFrame:
    """One row per selected row that any rule gives a value: the rules' values, later ones seeing earlier ones, a line number, and where it comes from."""
    out = selected(rows, plan)
    for name, tree in plan.row_rules.items():
        out = out.withColumn(name, plan_expression(tree))
    some = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in plan.row_rules])
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    out = out.where(some).withColumn("line_number", F.row_number().over(w).cast("long"))
    return out.select(*KEYS, "line_number", *plan.row_rules, t.squash(F.col("text")).alias("description"), F.col("page").alias("source_page"), "row_index")


def sums(items: DataFrame) -> DataFrame:
    """(doc_id, line_items_amount_sum, line_items_tax_sum); missing values count as nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)
    return items.groupBy(*KEYS).agg(total("amount").alias("line_items_amount_sum"), total("tax_amount").alias("line_items_tax_sum"))


def within(left: Column, right: Column, tolerance: float) -> Column:
    """Whether both sides are there and differ by the tolerance at most."""
    return F.coalesce(F.abs(left - right) <= F.lit(tolerance), F.lit(False))


def failures(rows: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, line_number, check): rows that a check of the plan fails on."""
    failed = F.array_compact(F.array(*[F.when(~within(plan_expression(a), plan_expression(b), tol), F.lit(name)) for name, a, b, tol in plan.checks]))
    return rows.select(*KEYS, "line_number", F.explode(failed).alias("check"))


def from_hints(hints: Mapping[str, str]) -> Plan:
    """A plan from the hints of older profiles: markers, patterns and an identifier; what a plan does not know is ignored."""
    rules: dict[str, Mapping[str, Any]] = {}
    if pattern := hints.get("identifier_pattern"):
        rules["service_id"] = {"op": "regex_extract", "args": [{"op": "field", "name": "text"}], "pattern": pattern, "group": 1}
    return Plan(start=hints.get("start", ""), end=hints.get("end", ""), include=hints.get("include"), exclude=tuple(x for x in hints.get("exclude", "").split(",") if x), row_rules=rules)
