"""Amounts printed in documents, as decimals.

Parsers differ on purpose: each kind of text has its own reading of separators.  A text that is no
amount gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

MONEY = "decimal(18,2)"
NUMBER = "decimal(18,6)"
#: A number with its sign, currency mark and parentheses; the second also begins with a point.
TOKEN = r"([-(]?\s*[$€£]?\s*\d[\d,]*(?:\.\d+)?\)?)"
LOOSE = r"([-(]?\s*[$€£]?\s*(?:\d[\d,]*(?:\.\d+)?|\.\d+)\)?)"
PERCENT = r"\(?-?\d[\d,.]*\s*%\)?"


def _pick(found: Column, first: bool = False) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, 1 if first else -1))


def _separated(bare: Column) -> Column:
    """Digits with commas: these group thousands beside a point or where three digits follow up to the end or a comma, else they are points."""
    comma, point = bare.contains(","), bare.contains(".")
    grouped = (comma & point) | bare.rlike(r",\d{3}(,|$)")
    return F.when(grouped, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))


def _signed(value: Column, negative: Column) -> Column:
    return F.when(negative & (value > 0), -value).otherwise(value)


def printed_amount(text: Column, *, ignore_percent: bool = False) -> Column:
    """The last number of a text; CR behind a number, or parentheses around it, make it negative."""
    source = F.regexp_replace(text, PERCENT, " ") if ignore_percent else text

    def signed(source: Column, raw: Column) -> Column:
        negative = (raw.contains("(") & raw.contains(")")) | source.rlike(r"(?i)\d\s*CR\b")
        number = let(F.regexp_replace(raw, r"[^\d.,\-]", ""), _separated).try_cast(NUMBER)
        return let(number, lambda n: _signed(n, negative))

    return let(source, lambda x: let(F.try_element_at(F.regexp_extract_all(x, F.lit(LOOSE), F.lit(1)), F.lit(-1)), lambda raw: signed(x, raw)))


def grouped_amount(text: Column, *, first: bool = False) -> Column:
    """The last (or first) number; a comma is always a thousands separator, parentheses around it negate."""
    raw = _pick(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), first)
    value = F.regexp_replace(raw, r"[^\d.\-]", "").try_cast(NUMBER)
    return _signed(value, F.trim(raw).rlike(r"^\(.*\)$"))


def stripped_amount(text: Column) -> Column:
    """The whole text less what is no digit, separator, sign or parenthesis."""
    bare = F.regexp_replace(F.trim(text), r"[^\d,.\-()]", "")
    return _signed(_separated(F.btrim(bare, F.lit("()"))).try_cast(NUMBER), bare.rlike(r"^\(.*\)$"))


def whole_amount(text: Column) -> Column:
    """The whole text as one number; of two kinds of separators the right-most is the decimal one, a lone ,ddd groups."""
    bare = F.regexp_replace(text, r"[^0-9.,-]", "")
    both = bare.contains(",") & bare.contains(".")
    comma_last = F.length(F.substring_index(bare, ",", -1)) < F.length(F.substring_index(bare, ".", -1))
    swapped = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(both & comma_last, swapped).when(both | bare.rlike(r"^-?\d{1,3}(,\d{3})+$"), F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return plain.try_cast(NUMBER)


def cell_amount(text: Column) -> Column:
    """A workbook cell: dollar signs and commas go, parentheses negate."""
    value = F.regexp_replace(text, r"[$,()\s]", "").try_cast(NUMBER)
    return F.when(text.rlike(r"^\s*\(.*\)\s*$"), -value).otherwise(value)


def money_tokens(text: Column) -> Column:
    """All amounts with two decimals."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d[\d,]*\.\d\d)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast(MONEY))


def tax_rate(rate: Column) -> Column:
    """A rate as a fraction: above 1 it is a percentage, exactly 1 is all of it."""
    return F.when(rate > 1, (rate / 100).cast(NUMBER)).otherwise(rate.cast(NUMBER))


def printed_rate(text: Column) -> Column:
    """The first percentage of a text as a fraction; a comma is a point there."""
    found = F.regexp_extract(text, r"\b(\d+(?:[.,]\d+)?)\s*%", 1)
    return (F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit(".")).try_cast(NUMBER) / 100).cast(NUMBER)


def from_end(values: Column, k: int) -> Column:
    """The k-th value from the end of an array, null if there are fewer."""
    return F.when(F.size(values) >= k, F.element_at(values, -k))


def quantity(amounts: Column, texts: Column) -> Column:
    """Of a row's numbers, the third from the end if its text is a plain whole number, else the second from the end."""
    third = from_end(texts, 3)
    return F.when(third.rlike(r"^\s*\d+\s*$"), from_end(amounts, 3)).otherwise(from_end(amounts, 2))
