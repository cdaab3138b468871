"""JSON payloads to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(rows: DataFrame, payload: str, schema: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows with the payload's fields as columns, renamed by alias; what does not parse gives nulls."""
    parsed = F.from_json(payload, schema, {"mode": "PERMISSIVE"})
    out = rows.withColumn("_p", parsed).select(*rows.columns, "_p.*")
    return out.withColumnsRenamed(aliases or {})


def compact(rows: DataFrame, payload: str, schema: str, aliases: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """typed() of short names, with defaults where a field is missing or blank."""
    out = typed(rows, payload, schema, aliases)
    return out.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)) for c, v in defaults.items()})


def versioned(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows with the fields of the second form, {"fields": {...}}, else of the first, flat one."""
    second, first = F.from_json(payload, f"fields struct<{', '.join(f'{n}:{k}' for n, k in (x.split() for x in schema.split(', ')))}>"), F.from_json(payload, schema)
    both = rows.withColumns({"_2": second, "_1": first})
    return both.select(*rows.columns, *[F.coalesce(F.col(f"_2.fields.{n}"), F.col(f"_1.{n}")).alias(n) for n in (x.split()[0] for x in schema.split(", "))])


def parsed(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    """typed() of the rows whose payload is JSON; the others are left out."""
    ok = F.try_parse_json(payload).isNotNull()
    return typed(rows.where(ok), payload, schema)


def problem(payload: Column, cut: Column) -> Column:
    """Why a model's answer cannot be used: empty, truncated by length, or malformed; null if it can."""
    bad = F.get_json_object(payload, "$").isNull()
    return F.when(F.trim(payload) == "", "empty").when(cut, "truncated").when(bad, "malformed")


def fenced(text: Column) -> Column:
    """The first JSON block of a Markdown text."""
    return F.nullif(F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1), F.lit(""))


def without_blank_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which some column holds more than blanks."""
    return rows.where(F.concat_ws("", *[F.trim(c) for c in columns]) != "")


def canonical(fields: list[str]) -> Column:
    """A JSON text of the fields in order, nulls left out, dates in ISO form."""
    return F.to_json(F.struct(*fields), {"dateFormat": "yyyy-MM-dd"})


def by_header(sheet: DataFrame, order: str, columns: list[str], wanted: list[str]) -> DataFrame:
    """Rows of a sheet under the wanted headers: its first row that is not blank is the header, in any case and without blanks around; a header that it lacks gives nulls.

    One row, the header, comes to the driver, as it decides which columns there are.
    """
    rows = without_blank_rows(sheet, columns)
    head = rows.orderBy(order).first()
    if head is None:
        return sheet.limit(0).select(*[F.lit(None).cast("string").alias(w) for w in wanted])
    at: dict[str, str] = {}
    for c in columns:
        at.setdefault((head[c] or "").strip().lower(), c)
    body = rows.where(F.col(order) > head[order])
    return body.select(*[(F.col(at[w.lower()]) if w.lower() in at else F.lit(None).cast("string")).alias(w) for w in wanted])
