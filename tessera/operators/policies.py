"""Policies that a profile declares: how labels, amounts, taxes and fields of rows are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, dates
from ..functions import text as t
from ..functions.amounts import MONEY, NUMBER


def other_label(value: Column, own: str, labels: list[str]) -> Column:
    """Whether a candidate value is in truth another known label: it holds one and has at most 12 characters more."""
    low = F.lower(value)
    hits = [low.contains(x.lower()) & (F.length(value) <= len(x) + 12) for x in labels if x.lower() != own.lower()]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def account_row(text: Column, role: Column) -> Column:
    """A row of an account table: a detail or service row without header and tax words, and two amounts."""
    words = F.lower(text).rlike(r"\b(description|quantity|vat|tax|total)\b")
    return role.isin("detail", "service_start") & ~words & (F.size(amounts.money_tokens(text)) >= 2)


def routable(models: DataFrame, fingerprint: Column, *, candidate: bool = False) -> DataFrame:
    """Models that a document may go to: approved ones of its fingerprint, or candidates with it or with none."""
    same = F.col("fingerprint") == fingerprint
    return models.where((F.col("status") == "candidate") & (same | F.col("fingerprint").isNull()) if candidate else (F.col("status") == "approved") & same)


def detectors(profile: DataFrame, needs: dict[str, tuple[str, ...]]) -> DataFrame:
    """Profiles with the names of the candidate detectors, in order, all of whose hints they have."""
    names = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [F.col(h).isNotNull() for h in hints]), F.lit(name)) for name, hints in needs.items()]))
    return profile.withColumn("detectors", F.array_join(names, ","))


def table_candidate(role: Column, cells: Column) -> Column:
    """Whether a row may stand in a table: by its role, or two cells of which one is an amount, an identifier or a summary."""
    held = F.exists(cells, lambda c: c["role"].isin("amount", "identifier", "summary"))
    return role.isin("anchor", "header", "service_start", "period_amount", "group_total") | ((F.size(cells) >= 2) & held)


def label_lookup(rows: DataFrame, labels: dict[str, str], doc: str, *, stated_page: str | None = None) -> DataFrame:
    """(doc, label, value): what stands behind a label in the first row that holds it with a value, rows of the stated page first; values that are no kind of theirs are passed over.

    Labels with their kinds (text, amount or date) are a profile's, so rows are scanned once for all of them.
    """
    each = [F.struct(F.lit(name).alias("label"), F.lit(kind).alias("kind")) for name, kind in labels.items()]
    held = rows.withColumn("_l", F.explode(F.filter(F.array(*each), lambda x: F.contains(F.lower(F.col("text")), F.lower(x["label"]))))).select("*", "_l.*").drop("_l")
    value = F.nullif(F.btrim(F.expr("substring(text, locate(lower(label), lower(text)) + length(label))"), F.lit(" :")), F.lit(""))
    valid = F.when(F.col("kind") == "amount", amounts.printed_amount(F.col("value")).isNotNull()).when(F.col("kind") == "date", dates.printed_date(F.col("value")).isNotNull()).otherwise(F.col("value").isNotNull())
    found = held.withColumn("value", value).where(F.coalesce(valid, F.lit(False)))
    first = F.lit(0) if stated_page is None else F.when(F.col("page") == F.col(stated_page), 0).otherwise(1)
    return found.groupBy(doc, "label").agg(F.min_by("value", F.struct(first, "page", "row_index")).alias("value"))


def amount_by(policy: str, values: Column, group_total: Column, labelled: Column) -> Column:
    """The amount of a group by its policy: its total, the first number, the labelled one, or the charges column, second from the end."""
    if policy == "group_total":
        return group_total
    if policy == "first_amount":
        return F.get(values, F.lit(0))
    if policy == "label_amount":
        return labelled
    if policy == "table_charges_column":
        return amounts.from_end(values, 2)
    raise ValueError(f"unknown amount policy {policy!r}")


def tax_by(policy: str, labelled: Column, column: Column, total: Column, amount: Column) -> Column:
    """The tax of a group by its policy: none, the sum of labelled ones, a column's, or total less amount; 0 counts as none."""
    found = {"none": F.lit(None), "label_amount": F.aggregate(labelled, F.lit(0).cast(NUMBER), lambda a, x: (a + x).cast(NUMBER)), "table_tax_column": column, "total_less_amount": total - amount}[policy]
    return F.nullif(found.cast(MONEY), F.lit(0).cast(MONEY))


def service_id(text: Column) -> Column:
    """The identifier that a table row begins with: letters and digits of five and more, else eight digits glued to an amount."""
    return F.coalesce(t.captured(text, r"^\s*([A-Z]{2,6}[-/]?\d[A-Z0-9\-/.]{3,})\b"), t.captured(text, r"^\s*(\d{8})(?=\d[\d,]*\.\d{2})"))


def reference(rows: DataFrame, keys: list[str], order: str, text: Column, head: Column) -> DataFrame:
    """(keys, block, reference): a head row's text and those of the rows after it, up to the next head, joined."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"_text": text, "_head": head}).withColumn("block", F.sum(F.col("_head").cast("int")).over(w).cast("long")).where("block > 0")
    held = F.array_sort(F.collect_list(F.struct(order, "_text")))
    return marked.groupBy(*keys, "block").agg(F.array_join(F.transform(held, lambda r: r["_text"]), " ").alias("reference"))


def value_after(rows: DataFrame, keys: list[str], order: str, label: Column, value: Column, reach: int = 4) -> DataFrame:
    """Rows with a label, and the first value in them or in the `reach` rows after them."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = F.coalesce("_value", *[F.lead("_value", k).over(w) for k in range(1, reach + 1)])
    return rows.withColumns({"_label": label, "_value": value}).withColumn("found", near).where("_label").drop("_label", "_value")


def context_defaults(rows: DataFrame, detail: DataFrame, keys: list[str], row: str, label: str) -> DataFrame:
    """(keys, default): the first value behind a label outside of the detail rows."""
    outside = rows.join(detail.select(*keys, row), [*keys, row], "left_anti")
    found = outside.withColumn("_v", t.labeled_value(F.col("text"), label)).where("_v is not null")
    return found.groupBy(*keys).agg(F.min_by("_v", row).alias("default"))


def coerced(rows: DataFrame, fields: dict[str, str], enums: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Text columns as their fields' kinds: string, integer, decimal, date, list (by commas) or an enumeration with its first value as the default."""
    def one(name: str, kind: str) -> Column:
        c = t.blank_to_null(F.col(name))
        if kind == "integer":
            return c.try_cast("decimal(18,0)").cast("long")
        if kind == "decimal":
            return c.try_cast(NUMBER)
        if kind == "date":
            return dates.field_date(c)
        if kind == "list":
            return t.label_list(c)
        if kind == "enum":
            allowed = (enums or {})[name]
            return F.when(F.lower(c).isin(*allowed), F.lower(c)).otherwise(allowed[0])
        return c

    return rows.withColumns({n: one(n, k) for n, k in fields.items()})


def schema_of(fields: dict[str, str]) -> str:
    """The schema by which JSON with these fields is read."""
    kinds = {"integer": "long", "decimal": NUMBER, "date": "date", "list": "array<string>"}
    return ", ".join(f"{n} {kinds.get(k, 'string')}" for n, k in fields.items())


def structural_pages(pages: DataFrame, keys: list[str], heading: Column, money_rows: Column) -> DataFrame:
    """Pages that reach a third of the peak of their score, two for each heading and one for three rows with amounts, eight at most."""
    score = heading * 2 + F.least(F.lit(8), F.floor(money_rows / 3))
    scored = pages.withColumn("score", score.cast("long"))
    peak = F.max("score").over(Window.partitionBy(*keys))
    return scored.withColumn("_peak", peak).where((F.col("score") > 0) & (F.col("score") >= F.greatest(F.lit(1), F.floor(F.col("_peak") / 3)))).drop("_peak")


def linked(references: DataFrame, texts: DataFrame, ref: str, doc: str) -> DataFrame:
    """(ref, doc, score): each reference (ref, value) with the document (doc, token) that holds most of its values; a tie links with none."""
    hits = references.select(ref, F.lower("value").alias("token")).distinct().join(texts.select(doc, F.lower("token").alias("token")).distinct(), "token")
    counts = hits.groupBy(ref, doc).agg(F.count("*").alias("score"))
    best = counts.groupBy(ref).agg(F.max("score").alias("score"))
    top = counts.join(best, [ref, "score"])
    return top.groupBy(ref, "score").agg(F.min(doc).alias(doc), F.count("*").alias("_n")).where("_n = 1").select(ref, doc, "score")


def in_band(cells: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """(keys, amount, reference): in a band the right-most cell that is an amount, and the first that looks like a reference."""
    inside = cells.where((F.col("x0") >= lo) & (F.col("x0") < hi)).withColumns({"_a": amounts.printed_amount(F.col("text")), "_r": F.when(F.col("text").rlike(r"^[A-Z]{2,}-?\d+$"), F.col("text"))})
    return inside.groupBy(*keys).agg(F.max_by("_a", F.when(F.col("_a").isNotNull(), F.col("x0"))).alias("amount"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("x0"))).alias("reference"))


def header_bounds(cells: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """(keys, lo, hi): the bounds of a column from the first cell that is its label, 4 to the left and 40 to the right."""
    held = cells.where(F.lower(F.trim("text")) == label.lower())
    return held.groupBy(*keys).agg(F.min_by(F.struct((F.col("x0") - 4).alias("lo"), (F.col("x1") + 40).alias("hi")), order).alias("b")).select(*keys, "b.*")
