"""Delivered rows: taxes of lines, output specifications with computed columns, packages."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.amounts import MONEY, NUMBER
from ..functions.text import transformed

RATE_SOURCES = ("invoice_rate", "invoice_totals", "consistent_lines")


class Field(NamedTuple):
    """A column of an output specification: a header and a path (a line's column, document.<column> or computed.<name>)."""

    header: str
    path: str
    fallback: str | None = None
    transforms: tuple[str, ...] = ()




def resolved_rates(documents: DataFrame, lines: DataFrame, *, doc: str = "doc_id", source: str = "auto") -> DataFrame:
    """Documents (tax_rate, tax, subtotal) with rate: the stated one, else tax over subtotal, else the one that all lines with a tax agree on to four decimals; or one of these by name."""
    each = F.when((F.col("amount") != 0) & F.col("tax_amount").isNotNull(), F.round(F.col("tax_amount") / F.col("amount"), 4))
    same = lines.groupBy(doc).agg(F.when(F.min(each) == F.max(each), F.min(each)).cast(NUMBER).alias("_lines"))
    out = documents.join(same, doc, "left")
    totals = F.when(F.col("subtotal") > 0, (F.col("tax") / F.col("subtotal")).cast(NUMBER))
    found = dict(zip(RATE_SOURCES, (F.col("tax_rate").cast(NUMBER), totals, F.col("_lines")), strict=True))
    return out.withColumn("rate", found.get(source, F.coalesce(*found.values()))).drop("_lines")


def line_tax(tax: Column, amount: Column, rate: Column) -> Column:
    """The printed tax of a line, else amount times rate, half up to cents."""
    return F.coalesce(tax.cast(MONEY), F.round(amount * rate, 2).cast(MONEY))


def delivered_value(value: Column, kind: str) -> Column:
    """Numbers with two decimals, dates in delivered form, ISO dates in texts too."""
    if kind.startswith("decimal") or kind in ("double", "float"):
        return F.round(value, 2).cast(MONEY)
    if kind == "date":
        return dates.delivered(value)
    return dates.delivered_text(value) if kind == "string" else value


def rows(documents: DataFrame, lines: DataFrame, spec: list[Field], *, doc: str = "doc_id") -> DataFrame:
    """The delivered rows of deliverable lines: the specification's columns, with line_tax from the documents' rate."""
    heads = documents.select(doc, F.struct(*documents.columns).alias("document"))
    joined = lines.join(heads, doc)
    computed = {"line_tax": line_tax(F.col("tax_amount"), F.col("amount"), F.col("document.rate"))}
    kinds = dict(lines.dtypes) | {f"document.{c}": t for c, t in documents.dtypes}

    def value(path: str) -> tuple[Column, str]:
        if path.startswith("computed."):
            name = path.removeprefix("computed.")
            return (computed[name], MONEY) if name in computed else (F.lit(None).cast("string"), "string")
        return F.col(path), kinds[path]

    out = []
    for f in spec:
        found, kind = value(f.path)
        if f.fallback is not None:
            found = F.coalesce(found, value(f.fallback)[0])
        if f.transforms:
            found, kind = transformed(found.cast("string"), list(f.transforms)), "string"
        out.append(delivered_value(found, kind).alias(f.header))
    return joined.select(*out)


def tax_sums(lines: DataFrame, rates: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, delivered_tax): the sum of the lines' taxes as they are delivered."""
    taxed = lines.join(rates.select(doc, "rate"), doc, "left")
    return taxed.groupBy(doc).agg(F.coalesce(F.sum(line_tax(F.col("tax_amount"), F.col("amount"), F.col("rate"))), F.lit(0)).cast(MONEY).alias("delivered_tax"))


def manifest(documents: DataFrame, sums: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, rows, total, total_due): sums of a delivered package as texts; a stated total of 0 counts as none."""
    due = F.when(F.col("total_due") != 0, F.col("total_due").cast("string"))
    return documents.join(sums, doc, "left").select(doc, F.coalesce("n_rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("total", F.lit(0).cast(MONEY)).cast("string").alias("total"), due.alias("total_due"))


def output_gate(documents: DataFrame, sums: DataFrame, number: Column, stated: str, *, doc: str = "doc_id", threshold: float = 0.01) -> DataFrame:
    """(doc, reason): why a model's output (n items, total) may not be delivered, by the first rule that holds: no number, no items, all zero, not reconciled; else ok."""
    both = documents.join(sums, doc, "left")
    off = F.abs(F.col("total").cast("double") - F.col(stated)) / F.nullif(F.abs(F.col(stated)), F.lit(0.0)) > threshold
    reason = F.when(~number, "no number").when(F.col("n").isNull(), "no items").when(F.col("total") == 0, "all zero").when(off, "not reconciled").otherwise("ok")
    return both.select(doc, reason.alias("reason"))


def extraction_log(lines: DataFrame, doc: str, amount: Column, party: str, day: str) -> DataFrame:
    """(doc, n_lines, total, suppliers, last_shipped): the log of an extraction."""
    return lines.groupBy(doc).agg(F.count("*").alias("n_lines"), F.sum(amount).cast(MONEY).alias("total"), F.count_distinct(party).alias("suppliers"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_shipped"))


def exceptions(documents: DataFrame, reasons: list[tuple[str, Column]], *, doc: str = "doc_id") -> DataFrame:
    """(doc, reason): documents that go to the exceptions, by the first reason that holds."""
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons])
    return documents.select(doc, reason.alias("reason")).where("reason is not null")


def preview(lines: DataFrame, columns: list[str], order: list[str], most: int, *, doc: str = "doc_id") -> DataFrame:
    """(doc, n_rows, payload): the first rows of each document as a JSON text, for a reader to look at."""
    w = Window.partitionBy(doc).orderBy(*order)
    first = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    held = F.array_sort(F.collect_list(F.struct("_n", *columns)))
    n = lines.groupBy(doc).agg(F.count("*").alias("n_rows"))
    return first.groupBy(doc).agg(F.to_json(F.transform(held, lambda r: F.struct(*[r[c].alias(c) for c in columns]))).alias("payload")).join(n, doc).select(doc, "n_rows", "payload")


def log_entries(events: DataFrame, details: str, started: str, ended: str) -> DataFrame:
    """Log rows with the milliseconds between start and end put into their JSON details."""
    ms = ((F.unix_micros(ended) - F.unix_micros(started)) / 1000).cast("long")
    parsed = F.coalesce(F.from_json(details, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return events.withColumn(details, F.to_json(F.map_concat(F.map_filter(parsed, lambda k, v: k != "duration_ms"), F.create_map(F.lit("duration_ms"), ms.cast("string")))))
