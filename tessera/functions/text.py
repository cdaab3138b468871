"""Text rules on columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS = {
    "digits_only": lambda c: F.regexp_replace(c, "[^0-9]", ""),
    "trim": lambda c: F.trim(c),
    "uppercase": lambda c: F.upper(c),
    "lowercase": lambda c: F.lower(c),
}


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def transformed(text: Column, names: list[str]) -> Column:
    for name in names:
        text = TRANSFORMS[name](text)
    return text


def after_label(text: Column, label: str, stops: list[str] = ()) -> Column:
    """What follows the label's first place, cut at the first of each stop label, without blanks and colons around it."""
    at = F.locate(label.lower(), F.lower(text))
    value = F.when(at > 0, F.substring(text, at + len(label), F.length(text)))
    for stop in stops:
        cut = F.locate(stop.lower(), F.lower(value))
        value = F.when(cut > 0, F.substring(value, F.lit(1), cut - 1)).otherwise(value)
    return F.nullif(F.btrim(value, F.lit(" :")), F.lit(""))


def mapped(text: Column, pairs: dict[str, str]) -> Column:
    """The value of the first key that the text holds, in any case; else the text."""
    out = text
    for key, value in reversed(pairs.items()):
        out = F.when(F.lower(text).contains(key.lower()), F.lit(value)).otherwise(out)
    return out


def has_any(text: Column, markers: str) -> Column:
    """Whether the text holds one of the comma-separated markers, in any case."""
    terms = [m.strip().lower() for m in markers.split(",") if m.strip()]
    out = F.lit(False)
    for t in terms:
        out = out | F.lower(text).contains(t)
    return out


def java_pattern(pattern: str) -> str | None:
    """A user's pattern in Java's dialect, Unicode-aware; None if it is malformed."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return "(?U)" + re.sub(r"\(\?P<", "(?<", pattern)


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found in the text; a malformed pattern is found nowhere."""
    found = java_pattern(pattern)
    return F.lit(False) if found is None else F.coalesce(text.rlike("(?i)" + found), F.lit(False))


def captured(text: Column, pattern: str) -> Column:
    """What the pattern's first group catches, or all of it if it has none; null without a match or for a malformed pattern."""
    found = java_pattern(pattern)
    if found is None:
        return F.lit(None).cast("string")
    return F.when(text.rlike(found), F.regexp_extract(text, found, 1 if re.compile(pattern).groups else 0))


def first_mapped(text: Column, pairs: dict[str, str]) -> Column:
    """The value of the first key that the text holds, in any case; else null."""
    return F.coalesce(*[F.when(F.lower(text).contains(k.lower()), F.lit(v)) for k, v in pairs.items()])


# Words that mark labels and table headers, and what is one role under several names.
LABEL_WORDS = (
    "invoice", "account", "date", "due", "total", "amount", "number",
    "bill", "period", "customer", "payment", "service", "description",
    "charge", "tax", "subtotal", "credit", "balance",
)
HEADER_WORDS = (
    "service", "description", "amount", "charge", "quantity", "rate",
    "circuit", "plan", "usage", "device", "number", "period", "mrc",
    "nrc", "total",
)
TAX_WORDS = ("vat", "gst", "tax")
CURRENCIES = ("usd", "eur", "gbp")


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def is_label(text: Column) -> Column:
    """A label: 3 to 60 characters, no parentheses, six words at most, and a label word in it."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    return F.coalesce(F.length(text).between(3, 60) & ~text.rlike("[()]") & (words <= 6) & _any_in(F.lower(text), LABEL_WORDS), F.lit(False))


def is_header(text: Column) -> Column:
    """A table header: 2 to 30 characters, no parentheses, four words at most, and a header word in it."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    return F.coalesce(F.length(text).between(2, 30) & ~text.rlike("[()]") & (words <= 4) & _any_in(F.lower(text), HEADER_WORDS), F.lit(False))


def plain_token(text: Column) -> Column:
    """A label in lower case, squeezed, without colons around; null with digits or if nothing stays."""
    token = F.btrim(squash(F.lower(text)), F.lit(": "))
    return F.when(~text.rlike(r"\d") & (token != ""), token)


def structural_token(text: Column) -> Column:
    """A label as it identifies a layout: lower case, squeezed, tax names as one, currencies out; null with digits or if nothing stays."""
    token = F.btrim(squash(F.lower(text)), F.lit(": "))
    token = F.regexp_replace(token, r"\b(" + "|".join(TAX_WORDS) + r")\b", "tax")
    token = F.regexp_replace(token, r"\bexcluding\b", "exclusive of")
    token = squash(F.regexp_replace(token, r"\b(" + "|".join(CURRENCIES) + r")\b", ""))
    return F.when(~text.rlike(r"\d") & ~token.isin("", "tax") & ~token.contains("purposes only"), token)


def anchor_match(text: Column, anchor: str) -> Column:
    """Whether a text is an anchor, or begins with it and has at most 25 characters and two words (or four in all) more."""
    low, want = F.rtrim(F.trim(F.lower(text)), F.lit(":")), anchor.lower().strip().rstrip(":")
    if not want:
        return F.lit(False)
    words = F.size(F.split(F.trim(low), r"\s+"))
    return (low == want) | (F.startswith(low, F.lit(want)) & (F.length(low) <= len(want) + 25) & (words <= max(len(want.split()) + 2, 4)))


def fingerprint(labels: Column, headers: Column, **more: Column) -> Column:
    """The layout's identity: a digest of a JSON text of its first 30 labels and 20 table headers, plain tokens in order, and more fields of a family."""
    tokens = lambda x, n: F.slice(F.array_sort(F.array_distinct(F.array_compact(F.transform(x, plain_token)))), 1, n)
    fields = {"labels": tokens(labels, 30), "table_headers": tokens(headers, 20), **more}
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256))


def labeled_value(text: Column, label: str, stops: list[str] = ()) -> Column:
    """What stands behind "label :", up to the next of the other labels."""
    found = captured(text, rf"(?i){re.escape(label)}\s*:\s*(.*)")
    for stop in stops:
        found = F.regexp_replace(found, rf"(?i)\s*{re.escape(stop)}\s*:.*$", "")
    return blank_to_null(found)


def label_list(text: Column) -> Column:
    """Comma-separated labels, trimmed, without blanks and without later repeats in other case."""
    each = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(each, F.lower)
    return F.filter(each, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def total_identifier(text: Column) -> Column:
    """The identifier behind the word total: five characters and more, with a digit, and no account of the form d-XXXX."""
    found = captured(text, r"(?i)\btotal\s+([A-Z0-9][A-Z0-9\-/.]{4,})\b")
    return F.when(found.rlike(r"\d") & ~found.rlike(r"^\d-[A-Z0-9]{4}$"), found)


def enumerated(text: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The allowed value that a text is, in any case and without blanks around; else the default."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*allowed), low).otherwise(default)


def evidence(text: Column, most: int = 240) -> Column:
    return F.substring(squash(text), 1, most)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def tokens_estimate(text: Column) -> Column:
    return F.expr("0L") + F.floor(F.length(text) / 4)


def currency_code(text: Column, aliases: dict[str, str], fallback: str = "USD") -> Column:
    """(code, warning): three letters stand for themselves, then whole aliases, then aliases within the text; else the fallback with a warning."""
    bare = F.trim(text)
    whole = F.coalesce(*[F.when(F.lower(bare) == k.lower(), F.lit(v)) for k, v in aliases.items()])
    code = F.coalesce(F.when(bare.rlike(r"^[A-Za-z]{3}$"), F.upper(bare)), whole, first_mapped(bare, aliases))
    warning = F.when(code.isNull(), F.concat(F.lit("currency not recognised: "), F.coalesce(bare, F.lit(""))))
    return F.struct(F.coalesce(code, F.lit(fallback)).alias("code"), warning.alias("warning"))


def bare(text: Column) -> Column:
    """Lower-case letters and digits alone, by which printed values are found in texts."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")
