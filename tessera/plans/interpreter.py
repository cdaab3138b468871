"""Rule models: from rows of a document to delivered items, as one declarative plan.

A model is a value: a region, classifiers, a grouping and field rules.  run() compiles it to windows and
aggregates over rows (doc_id, page, row_index, text, cells), cells being an ordered array of (text, x0, x1).
All rows of a group meet in one array, which a document bounds.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, dates
from ..functions import text as t
from ..functions.binding import let, once
from ..operators import sequences
from . import rules

KEYS, ORDER = ["doc_id"], ["page", "row_index"]
#: Charge types that stay as they are named; everything else is recurring.
CHARGE_TYPES = ("recurring", "one_time", "usage", "tax", "fee", "surcharge", "credit")


@dataclass(frozen=True)
class Region:
    """Rows after a start anchor up to an end anchor; without start anchors the whole document."""

    start: tuple[str, ...] = ()
    end: tuple[str, ...] = ()
    keep_anchor: bool = False
    pages: tuple[int, ...] = ()
    resume: bool = False  # an end is a page's footer: the next page goes on
    columns: Mapping[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    """Where a field's text is: which rows of the group, which column, which part by pattern."""

    rows: str = "all"  # all, first, last, emit, or a role
    column: str | None = None
    pattern: str | None = None
    join: str | None = None
    last: bool = False


@dataclass(frozen=True)
class Rule:
    """A field: an operation on operands, a literal, several sources, or one source; then a transform."""

    source: Source | None = None
    sources: tuple[Source, ...] = ()
    operation: str | None = None  # extract, sum, subtract, product of operands
    operands: tuple[Source | str, ...] = ()  # a source, "const:1.5" or "ref:name"
    literal: str | None = None
    kind: str = "text"  # text, decimal, integer, date
    values: Mapping[str, str] = field(default_factory=dict)
    default: str | None = None
    hint: str | None = None


@dataclass(frozen=True)
class Model:
    region: Region
    classifiers: tuple[tuple[str, Mapping[str, Any]], ...]
    grouping: tuple[Any, ...]  # ("single", role), ("span", start, end, inclusive) or ("transition", start)
    fields: Mapping[str, Rule]
    emit: str | None = None  # a role of which every row is an item; else one item a group


def contains_any(text: Column, anchors: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(a.lower()) for a in anchors if a], F.lit(False))


def in_column(cells: Column, bounds: tuple[float, float]) -> Column:
    """Texts of the cells whose centre lies within the bounds, joined; null if there is none."""
    held = F.filter(cells, lambda c: ((c["x0"] + c["x1"]) / 2).between(*bounds))
    return let(F.trim(F.array_join(F.transform(held, lambda c: c["text"]), " ")), lambda x: F.when(x != "", x))


def row_matches(where: Mapping[str, Any], text: Column, cells: Column, columns: Mapping[str, tuple[float, float]]) -> Column:
    """All of a rule's conditions: min_cells, row_text, pattern in a column or in the row, an amount in a column."""
    out = rules.row_matches({k: v for k, v in where.items() if k in ("row_text", "exclude", "min_length", "min_cells")}, text, cells)
    inside = lambda name: in_column(cells, columns[name]) if name in columns else F.lit(None).cast("string")
    if "pattern" in where:
        out = out & t.matches(inside(where["column"]) if "column" in where else text, where["pattern"])
    if "has_amount_in_column" in where:
        out = out & amounts.printed_amount(inside(where["has_amount_in_column"])).isNotNull()
    return out


def locate(rows: DataFrame, region: Region) -> DataFrame:
    """The rows of the region, in any number of stretches.  Anchor rows count as rows only with keep_anchor; an end closes before a start opens again."""
    if region.pages:
        rows = rows.where(F.col("page").isin(list(region.pages)))
    start, end = contains_any(F.col("text"), region.start), contains_any(F.col("text"), region.end)
    keys = [*KEYS, "page"] if region.resume and not region.start else KEYS
    state = rules.state_before(rows.withColumns({"_start": start, "_end": end}), keys, ORDER, F.col("_start"), F.col("_end"), opened=not region.start)
    if region.resume and region.start:  # later pages of an opened region begin inside it
        by_page = Window.partitionBy(*KEYS, "page").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
        opened = F.coalesce(F.max(F.col("_start").cast("int")).over(Window.partitionBy(*KEYS).orderBy("page").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        event = F.when(F.col("_end"), 0).when(F.col("_start"), 1)
        state = state.withColumn("_in", F.coalesce(F.last(event, ignorenulls=True).over(by_page), opened))
    kept = (F.col("_in") == 1) & ~F.col("_end") & (F.lit(region.keep_anchor) | ~F.col("_start"))
    if region.keep_anchor:
        kept = kept | ((F.col("_in") == 0) & F.col("_start"))
    return state.where(kept).drop("_in", "_start", "_end")


def grouped(rows: DataFrame, grouping: tuple[Any, ...]) -> DataFrame:
    """Rows (with role) that belong to a group, with group 1, 2, ... in a document."""
    kind, *args = grouping
    if kind == "single":
        w = Window.partitionBy(*KEYS).orderBy(*ORDER)
        return rows.where(F.col("role") == args[0]).withColumn("group", F.row_number().over(w).cast("long"))
    if kind == "transition":
        return sequences.transition_groups(rows, KEYS, ORDER, F.col("role") == args[0])
    if kind == "span":
        start, end, inclusive = args
        return sequences.spans(rows, KEYS, ORDER, F.col("role") == start, F.col("role") == end, inclusive=inclusive).withColumnRenamed("span", "group")
    raise ValueError(f"unknown grouping {kind!r}")


def _text_of(source: Source, rows: Column, emit: Column, columns: Mapping[str, tuple[float, float]]) -> Column:
    """The source's text among a group's rows; null if no row has any."""
    if source.rows == "emit":
        chosen = F.when(emit.isNotNull(), F.array(emit))
    elif source.rows in ("all", "first", "last"):
        chosen = {"all": rows, "first": F.slice(rows, 1, 1), "last": F.slice(rows, -1, 1)}[source.rows]
    else:
        chosen = F.filter(rows, lambda r: r["role"] == source.rows)

    def text(r: Column) -> Column:
        out = r["text"]
        if source.column is not None:
            out = in_column(r["cells"], columns[source.column]) if source.column in columns else F.lit(None).cast("string")
        if source.pattern is not None:
            out = t.captured(out, source.pattern)
        return let(F.trim(out), lambda x: F.when(x != "", x))

    found = F.array_compact(F.transform(chosen, text))
    if source.join is not None:
        return let(F.array_join(found, source.join), lambda x: F.when(x != "", x))
    return F.try_element_at(found, F.lit(-1 if source.last else 1))


def transformed(raw: Column, rule: Rule) -> Column:
    """The typed value of a field's text: a value map (or its default), then the kind."""
    value = F.trim(raw)
    if rule.values:
        mapped = t.first_mapped(value, dict(rule.values))
        value = F.coalesce(mapped, F.lit(rule.default)) if rule.default is not None else F.coalesce(mapped, value)
        value = F.when(raw.isNotNull(), value)
    if rule.default is not None:
        value = F.coalesce(value, F.lit(rule.default))
    if rule.kind == "decimal":
        return amounts.printed_amount(value)
    if rule.kind == "integer":
        return amounts.printed_amount(value).cast("long")
    if rule.kind == "date":
        return dates.printed_date(value, hint=rule.hint)
    return F.nullif(value, F.lit(""))


def _operand(operand: Source | str, rows: Column, emit: Column, columns: Mapping[str, tuple[float, float]], known: Mapping[str, Column]) -> Column:
    """An operand's number: extracted from a source, constant, or that of an earlier field or a document's total."""
    if isinstance(operand, Source):
        return amounts.printed_amount(_text_of(operand, rows, emit, columns))
    kind, _, value = operand.partition(":")
    if kind == "const":
        return amounts.printed_amount(F.lit(value))
    return known[value].cast(amounts.NUMBER) if value in known else F.lit(None).cast(amounts.NUMBER)


def field_value(rule: Rule, rows: Column, emit: Column, columns: Mapping[str, tuple[float, float]], known: Mapping[str, Column]) -> Column:
    """An operation comes before a literal, that before several sources, these before one source, and the default is last."""
    from .expressions import value_expression

    if rule.operation is not None:
        return value_expression(rule.operation, [_operand(o, rows, emit, columns, known) for o in rule.operands])
    if rule.literal is not None:
        return transformed(F.lit(rule.literal), rule)
    if rule.sources:
        texts = [_text_of(s, rows, emit, columns) for s in rule.sources]
        if rule.kind == "decimal":
            return let(F.array(*[amounts.printed_amount(x) for x in texts]), lambda x: value_expression("sum", [F.get(x, F.lit(k)) for k in range(len(texts))]))
        return F.nullif(F.concat_ws(" ", *texts), F.lit(""))
    if rule.source is not None:
        return transformed(_text_of(rule.source, rows, emit, columns), rule)
    return transformed(F.lit(rule.default).cast("string"), rule)


def charge_type(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.isin(*CHARGE_TYPES), low).otherwise("recurring")


def candidates(rows: DataFrame, model: Model, totals: DataFrame | None = None) -> DataFrame:
    """One row per item that the model tries to make: doc_id, group, rows, emit and the field values; those without an amount are not yet dropped."""
    columns = model.region.columns
    marked = locate(rows, model.region)
    role = reduce(lambda out, rule: out.when(row_matches(rule[1], F.col("text"), F.col("cells"), columns), rule[0]), model.classifiers, F.when(F.lit(False), ""))
    held = grouped(marked.withColumn("role", role.otherwise("detail")), model.grouping)
    row = F.struct("page", "row_index", "role", "text", "cells")
    groups = held.groupBy(*KEYS, "group").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    if model.emit is None:
        items = groups.withColumn("emit", F.lit(None).cast(groups.schema["rows"].dataType.elementType))
    else:
        items = groups.withColumn("emit", F.explode(F.filter("rows", lambda r: r["role"] == model.emit)))
    known: dict[str, Column] = {}
    if totals is not None:
        items = items.join(totals, KEYS, "left")
        known = {c: F.col(c) for c in totals.columns if c not in KEYS}
    for name, rule in model.fields.items():  # later fields see earlier ones
        items = items.withColumn(name, field_value(rule, F.col("rows"), F.col("emit"), columns, known))
        known[name] = F.col(name)
    return items


def delivered_items(items: DataFrame, model: Model) -> DataFrame:
    """Items with an amount, numbered in order: description and page get their defaults, charge types are safe."""
    at = F.coalesce(F.col("emit"), F.get("rows", F.lit(0)))
    detail = F.transform(F.filter("rows", lambda r: r["role"] == "detail"), lambda r: r["text"])
    plain = F.when(F.size(detail) > 0, F.array_join(detail, "; ")).otherwise(F.get("rows", F.lit(0))["text"])
    given = F.col("description") if "description" in model.fields else F.lit(None).cast("string")
    kind = F.col("charge_type") if "charge_type" in model.fields else F.lit(None).cast("string")
    w = Window.partitionBy(*KEYS).orderBy("group", "_at")
    out = once(items, "amount").where("amount is not null").withColumns({"_at": F.struct(at["page"], at["row_index"]), "description": F.substring(F.coalesce(given, plain), 1, 500), "charge_type": charge_type(kind), "source_page": at["page"]})
    others = [n for n in model.fields if n not in ("description", "charge_type")]
    return out.withColumn("line_number", F.row_number().over(w).cast("long")).select(*KEYS, "line_number", "charge_type", "description", "source_page", *others)


def dropped_items(items: DataFrame) -> DataFrame:
    """(doc_id, group, reason, text): items without an amount, with the first text of their group."""
    return items.where("amount is null").select(*KEYS, "group", F.lit("missing amount").alias("reason"), F.get("rows", F.lit(0))["text"].alias("text"))


def run(rows: DataFrame, model: Model, totals: DataFrame | None = None) -> DataFrame:
    return delivered_items(candidates(rows, model, totals), model)


def assembled(headers: DataFrame, run_date: str) -> DataFrame:
    """Document headers with the defaults of a document: number UNKNOWN, the run's date, three letters of currency or USD."""
    code = F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("USD"))
    return headers.withColumns({"number": F.coalesce(F.nullif(F.trim("number"), F.lit("")), F.lit("UNKNOWN")), "date": F.coalesce("date", F.lit(run_date).cast("date")), "currency": F.substring(code, 1, 3)})


def self_check(items: DataFrame, totals: DataFrame, total: str, tolerance: float = 0.01) -> DataFrame:
    """(doc_id, items_sum, ok): whether the items that are no tax, fee or surcharge add up to a stated total; a document without it passes."""
    plain = F.when(~F.col("charge_type").isin("tax", "fee", "surcharge"), F.col("amount"))
    sums = items.groupBy(*KEYS).agg(F.coalesce(F.sum(plain), F.lit(0)).cast(amounts.MONEY).alias("items_sum"))
    stated = F.col(total)
    return sums.join(totals.select(*KEYS, total), KEYS, "left").select(*KEYS, "items_sum", F.coalesce(F.abs(F.col("items_sum") - stated) <= F.lit(tolerance).cast(amounts.MONEY), F.lit(True)).alias("ok"))
