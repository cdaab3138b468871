"""Joins and lookups beyond plain equality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .needles import PART, matches


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given, ties broken by it too."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def best_match(left: DataFrame, right: DataFrame, key: list[str], tiers: list[Column], left_id: list[str], order: list[Column]) -> DataFrame:
    """Each left row with the right row of the best tier (1, 2, ...) within its key, first by order; unmatched rows stay."""
    tier = F.coalesce(*[F.when(c, F.lit(k)) for k, c in enumerate(tiers, 1)])
    joined = left.join(right, key, "left").withColumn("tier", tier)
    w = Window.partitionBy(*left_id).orderBy(F.col("tier").asc_nulls_last(), *order)
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def banded(rows: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """Rows with the band (lo, hi, band) that lo <= value < hi holds; bands are a small table of fixed size."""
    return rows.join(bands, (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")), "left").drop("lo", "hi")


def run_compare(before: DataFrame, after: DataFrame, key: list[str], score: str) -> DataFrame:
    """(key, before, after, outcome) of two runs: new, missing, unscored, regressed, improved or unchanged."""
    joined = before.select(*key, F.col(score).alias("before"), F.lit(True).alias("_b")).join(after.select(*key, F.col(score).alias("after"), F.lit(True).alias("_a")), key, "full")
    delta = F.col("after") - F.col("before")
    outcome = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "missing").when(delta.isNull(), "unscored").when(delta < 0, "regressed").when(delta > 0, "improved").otherwise("unchanged")
    return joined.select(*key, "before", "after", outcome.alias("outcome"))


def owners(rows: DataFrame, place: str, owner: str) -> DataFrame:
    """(place, n_owners, state): unmapped, mapped or conflict by the number of distinct owners."""
    n = F.count_distinct(owner)
    return rows.groupBy(place).agg(n.alias("n_owners"), F.when(n == 0, "unmapped").when(n == 1, "mapped").otherwise("conflict").alias("state"))


#: Base of the gram hashes of minimizers(), modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def minimizers(data: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Hashes of `gram` bytes that are least among `window` of them in a row, without repeats in a row.

    A string of gram + window - 1 bytes has at least one, and every text that holds the string has it too.
    """
    if len(data) < gram + window - 1:
        return np.zeros(0, np.uint64)
    h, span = data.astype(np.uint64) + np.uint64(1), 1
    while span * 2 <= gram:
        h = h[:-span] * np.uint64(pow(_BASE, span, 1 << 64)) + h[span:]
        span *= 2
    n = len(data) - gram + 1
    if span < gram:
        h = h[:n] * np.uint64(_BASE) + h[gram - span : gram - span + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least, span = h, 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        m = len(h) - window + 1
        least = np.minimum(least[:m], least[window - span : window - span + m])
    return np.unique(least)


def _grams(gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k, text in enumerate(b.column(1)):
                with np.errstate(over="ignore"):
                    g = minimizers(np.frombuffer((text.as_py() or "").encode(), np.uint8), gram, window).view(np.int64)
                at.append(np.full(len(g), k))
                found.append(g)
            rows = np.concatenate(at) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["key", "gram"])

    return run


def contained(needles: DataFrame, texts: DataFrame, *, needle: str, text: str, needle_key: str, text_key: str, strip: str = r"[\s,\-]+", gram: int = 8, window: int = 8, part: int = PART) -> DataFrame:
    """(needle_key, text_key) of the texts that hold a needle, in any case and blind to what the pattern strips.

    Needles of up to `part` bytes together are found by one pass over the texts, with an automaton.  Of a larger set,
    those of gram + window - 1 bytes and more are looked up in an index: texts are indexed by minimizers of their bytes,
    of which such a needle has one at least; needle and text meet in an equi-join on the needle's rarest hash and are then
    compared.  Its shorter ones go by automata, part by part.  Blank needles are nowhere.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.col(c)), strip, "")
    n = needles.select(F.col(needle_key).alias("_n"), bare(needle).alias("_needle")).where("_needle <> ''")
    x = texts.select(F.col(text_key).alias("_x"), bare(text).alias("_text")).where("_text is not null")
    long = F.octet_length("_needle") >= gram + window - 1
    size = n.agg(F.sum(F.octet_length("_needle")).alias("bytes"), F.count_if(~long).alias("short")).first()
    few = (size.bytes or 0) <= part
    pairs = matches(x, "_text", n if few else n.where(~long), "_needle", part=part).select("_x", F.col("needle").alias("_needle")).join(n, "_needle").select("_n", "_x") if few or size.short else None
    if not few:
        kind = lambda df: df.schema[0].dataType.simpleString()
        indexed = x.mapInArrow(_grams(gram, window), f"key {kind(x)}, gram long")
        looked = n.where(long).mapInArrow(_grams(gram, window), f"key {kind(n)}, gram long").withColumnRenamed("key", "_n")
        shared = indexed.join(looked.select("gram").distinct(), "gram", "left_semi")
        often = shared.groupBy("gram").agg(F.count("*").alias("df"))
        rarest = looked.join(often, "gram", "left").groupBy("_n").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
        met = shared.join(rarest, "gram").select("_n", F.col("key").alias("_x")).distinct().join(n, "_n").join(x, "_x").where(F.contains("_text", "_needle")).select("_n", "_x")
        pairs = met if pairs is None else pairs.union(met)
    return pairs.select(F.col("_n").alias(needle_key), F.col("_x").alias(text_key)).distinct()


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How far two intervals overlap, 0 if they do not."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, share: float = 0.35) -> Column:
    """Whether two intervals overlap by a share of the narrower one."""
    return overlap(a0, a1, b0, b1) >= share * F.least(a1 - a0, b1 - b0)


def under_label(labels: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """Labels (key, label, x0, x1) with the text of the cell (key, text, x0, x1) that overlaps most, else of the nearest centre, first in order of place."""
    c = cells.select(*key, F.col("text"), F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    over = overlap(F.col("x0"), F.col("x1"), F.col("c0"), F.col("c1"))
    distance = F.abs((F.col("x0") + F.col("x1")) - (F.col("c0") + F.col("c1"))) / 2
    return labels.join(c, key).groupBy(*key, "label").agg(F.min_by("text", F.struct(-over, distance, "c0")).alias("text"))


def carried_with_barrier(rows: DataFrame, keys: list[str], order: list[str], value: Column, barrier: Column, name: str) -> DataFrame:
    """Rows with the last value before them that no barrier row stands behind; a barrier row itself still sees it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumns({"_value": value, "_barrier": barrier.cast("int")}).withColumn("_era", F.coalesce(F.sum("_barrier").over(w), F.lit(0)))
    inner = Window.partitionBy(*keys, "_era").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.last("_value", ignorenulls=True).over(inner)).drop("_value", "_barrier", "_era")


def aligned(rows: DataFrame, headers: list[str], wanted: list[str]) -> DataFrame:
    """Columns of rows by the wanted headers, in any case and without blanks around; of equal headers the first, of missing ones null."""
    at: dict[str, str] = {}
    for column, header in zip(rows.columns, headers, strict=True):
        at.setdefault(header.strip().lower(), column)
    return rows.select(*[(F.col(at[w.strip().lower()]) if w.strip().lower() in at else F.lit(None)).cast("string").alias(w) for w in wanted])


def best_evidence(values: DataFrame, rows: DataFrame, key: list[str], forms: Column, score: Column, order: list[str]) -> DataFrame:
    """values (key, name, ...) with the order and text of the best row of their document that holds one of their printed forms."""
    held = values.withColumn("_forms", forms).join(rows.withColumn("_score", score), key)
    hit = held.where(F.exists("_forms", lambda f: F.contains(F.col("text"), f)))
    w = Window.partitionBy(*key, "name").orderBy(F.col("_score").desc(), *order)
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*key, "name", *order, "text")


def equal_value_sets(left: DataFrame, right: DataFrame, name: str, value: str) -> DataFrame:
    """(name, other): names of left and right whose distinct non-null values are the same set, compared by count and two hashes."""
    sign = lambda df: df.where(F.col(value).isNotNull()).select(name, value).distinct().groupBy(name).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(value)).alias("x"), F.sum(F.hash(value).cast("long")).alias("s"))
    return sign(left).join(sign(right).withColumnRenamed(name, "other"), ["n", "x", "s"]).select(name, "other")


def overridden(base: DataFrame, overrides: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Base rows with the non-null columns of the override of their key; overrides without a base row are appended."""
    o = overrides.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(o, key, "full").select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])
