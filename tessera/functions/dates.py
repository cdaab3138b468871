"""Dates printed in documents; what is no date gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which formats are tried decides ambiguous dates.
RULE_FORMATS = ("d MMM yyyy", "d MMM yy", "d-MMM-yyyy", "d-MMM-yy", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy", "MMM d, yyyy", "MMM. d, yyyy", "d MMMM yyyy")
FIELD_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "d MMM yyyy", "d MMM yy", "d-MMM-yyyy", "d-MMM-yy", "d.M.yyyy", "MMM d, yyyy", "MMM. d, yyyy", "d MMMM yyyy")
COMPARE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "d MMM yyyy", "d-MMM-yyyy")
# What looks like a date within a text.
EMBEDDED = r"(\d{1,2}[-/ ][A-Za-z]{3,9}\.?[-/ ]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{2,4})"


def _shape(form: str) -> str | None:
    """A pattern that every text has which a format of days, months and years reads; none for other formats."""
    parts = re.findall(r"d+|M+|y+|[ \-/.,]|.", form)
    if any(p[0] not in "dMy -/.," for p in parts):
        return None
    return "^" + "".join(re.escape(p) if p[0] not in "dMy" else r"\D+" if p.startswith("MMM") else r"[+\-]?\d+" for p in parts) + "$"


def _read(text: Column, form: str) -> Column:
    day, shape = F.to_date(F.try_to_timestamp(text, F.lit(form))), _shape(form)
    day = F.when(text.rlike(shape), day) if shape else day  # a text that is not read costs an exception
    if "yyyy" in form or "yy" not in form:
        return day
    # two digits from 69 on are of the century before
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def _whole(text: Column, formats: tuple[str, ...]) -> Column:
    """The first format that reads the text, then the text without the point behind a month."""
    bare = F.regexp_replace(text, r"\b([A-Za-z]{3,9})\.(?=\s+\d)", "$1")
    read = lambda t: F.coalesce(*[_read(t, f) for f in formats])
    return F.coalesce(read(text), F.when(bare != text, read(bare)))


def printed_date(text: Column, formats: tuple[str, ...] = RULE_FORMATS, hint: str | None = None, *, embedded: bool = True) -> Column:
    """The first format that reads the whole trimmed text, the hint before all; else, if embedded, the first date within it."""
    order, bare = ((hint, *formats) if hint else formats), F.trim(text)
    found = _whole(bare, order)
    if not embedded:
        return found
    token = F.regexp_extract(bare, EMBEDDED, 1)
    return F.coalesce(found, F.when((token != "") & (token != bare), _whole(token, order)))


def field_date(text: Column, hint: str | None = None) -> Column:
    """A stored field: an ISO date in the first ten characters goes first, then the formats of fields."""
    bare = F.trim(text)
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(F.substring(bare, 1, 10), F.lit("yyyy-MM-dd"))))
    return F.coalesce(iso, printed_date(text, FIELD_FORMATS, hint))


def period(text: Column, formats: tuple[str, ...] = RULE_FORMATS) -> tuple[Column, Column]:
    """The two ends of a period: around " - ", else the first two dates of the text."""
    halves = F.split(text, " - ", 2)
    found = F.regexp_extract_all(text, F.lit(EMBEDDED), F.lit(1))
    cut = F.size(halves) == 2
    pick = lambda k: F.when(cut, F.get(halves, F.lit(k))).otherwise(F.get(found, F.lit(k)))
    return printed_date(pick(0), formats), printed_date(pick(1), formats)


def comparable(text: Column) -> Column:
    """A date in ISO form, else the squeezed text."""
    day = printed_date(text, COMPARE_FORMATS, embedded=False)
    return F.coalesce(day.cast("string"), F.trim(F.regexp_replace(text, r"\s+", " ")))


def printed_forms(date: Column) -> Column:
    """The ways in which a date may stand in a text, without repeats."""
    forms = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "M/d/yyyy", "d/M/yyyy", "dd MMM yyyy", "d MMM yyyy", "dd-MMM-yyyy", "d-MMM-yyyy", "MMM d, yyyy")
    return F.array_distinct(F.array(*[F.date_format(date, f) for f in forms]))


def delivered(date: Column) -> Column:
    return F.date_format(date, "MM/dd/yyyy")


def delivered_text(text: Column) -> Column:
    """ISO dates in delivered form; other texts as they are."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))
    return F.coalesce(delivered(iso), text)


def format_guess(text: Column) -> Column:
    """The format that a printed date suggests."""
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), "d/M/yyyy").when(text.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), "d MMM yyyy").when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "yyyy-MM-dd")


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def month_end(date: Column) -> Column:
    return F.last_day(date)


def month_keys(day: Column, n: int) -> Column:
    """First days of the n months up to a day's own."""
    return F.sequence(F.add_months(F.trunc(day, "month"), 1 - n), F.trunc(day, "month"), F.expr("interval 1 month"))
