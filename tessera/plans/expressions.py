"""Expressions over line items, given as nested dicts and compiled to columns.

Two dialects share a compiler but not their null rules: a plan's arithmetic is null if any part is; a
value rule's sum and difference count missing parts as nothing, unless all are missing.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, text

DECIMAL = "decimal(18,6)"


def plan_expression(tree: Mapping[str, Any]) -> Column:
    """Operations literal, field, copy, regex_extract, sum, subtract, multiply, abs, coalesce, month_start, month_end."""
    op, args = tree["op"], [plan_expression(a) for a in tree.get("args", ())]
    if op == "literal":
        return F.lit(tree["value"])
    if op in ("field", "copy", "row_column"):
        return F.col(tree["name"])
    if op == "regex_extract":
        pattern = text.java_pattern(tree["pattern"])
        return F.nullif(F.regexp_extract(args[0], pattern, tree.get("group", 0)), F.lit("")) if pattern else F.lit(None).cast("string")
    if op in ("sum", "multiply", "subtract"):
        out = args[0].cast(DECIMAL)
        for a in args[1:]:
            a = a.cast(DECIMAL)
            out = (out + a if op == "sum" else out - a if op == "subtract" else out * a).cast(DECIMAL)
        return out
    if op == "abs":
        return F.abs(args[0])
    if op == "coalesce":
        return F.coalesce(*[F.nullif(a.cast("string"), F.lit("")) for a in args])
    if op == "month_start":
        return dates.month_start(args[0])
    if op == "month_end":
        return dates.month_end(args[0])
    raise ValueError(f"unknown operation {op!r}")


def value_expression(op: str, parts: list[Column]) -> Column:
    """extract: the first there is; sum: missing as 0; subtract: the first less what there is of the others; product: all or null."""
    parts = [p.cast(DECIMAL) for p in parts]
    some = F.coalesce(*parts)
    zero = F.lit(0).cast(DECIMAL)
    if op == "extract":
        return some
    if op == "sum":
        out = zero
        for p in parts:
            out = out + F.coalesce(p, zero)
        return F.when(some.isNotNull(), out).cast(DECIMAL)
    if op == "subtract":
        out = parts[0]
        for p in parts[1:]:
            out = out - F.coalesce(p, zero)
        return out.cast(DECIMAL)
    if op == "product":
        out = parts[0]
        for p in parts[1:]:
            out = (out * p).cast(DECIMAL)
        return out
    raise ValueError(f"unknown operation {op!r}")
