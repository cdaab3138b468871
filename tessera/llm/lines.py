"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go.

A line counts, without surrounding blanks, if it has at least `least` characters; shorter lines stay.
The queries take every line that is not blank (least=1).  First, equal lines are one class, with its
earliest place.  Then for each distinct line of at least `near` characters, below which one edit is no near
copy any more ("page 1", "page 2"):

1. Blocks: its text less one of `parts` blocks, given by the left and the right end that stay.  The block
   size is one for all lines of about a length, so two lines within one edit share the ends around it,
   and a line whose keys are all its own is settled.  Halves come first; only lines that share one of
   them are fetched and cut into finer blocks, into `FEW` where a line has fewer characters than parts.
2. Within the blocks that are shared, all variants of one deletion are emitted as hashed keys, with the
   place for a substitution, without for an insertion, which meets the shorter line itself.

Lines that share a variant with its place differ by that character at most, so the earliest of a key
stands for the whole group and is found by an aggregate with map-side partials: no pairs are formed, and
no group is gathered.  The pair of each line and its earliest neighbour is verified by edit distance.

Which line is earliest goes by (doc_id, hash of the text, line number), a null id last; a line goes if any earlier line of the input is
within the bound.  Null and empty texts have no lines that count and stay.  Very long texts are split whole.  Documents that lost lines
and keep none that counts are dropped by dedup(), or stay with an empty text and a flag.  Rows that
repeat an id and a text are treated alike: each keeps what is first.  An empty table gives an empty result.  Other
columns are kept; those named like an added one (n_removed, the flag) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Plain, Rolling, Workspace, own_names, slices

LEAST, PARTS = 24, 24
#: Least length for the search of one edit, a twelfth of the line at most, and blocks of lines shorter than PARTS.
NEAR, FEW = 12, 4
_STRIP = " \t\r\x0b\x0c"
_BLANK = np.zeros(128, bool)
_BLANK[[ord(c) for c in _STRIP + "\n"]] = True
SCANNED = "id long, k long, n int, h1 long, h2 long, keys array<long>"
KEYS = "h1 long, h2 long, key long, hole_from int, hole_to int"
#: Block sizes: whole numbers in steps of about an eighth.
_SIZES = np.unique((1.12 ** np.arange(220)).astype(np.int64))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the offsets."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def line_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, number, start, end) of all lines, without the blanks around them; an empty last line is left out."""
    breaks = np.flatnonzero(codes == 10)
    some = np.diff(offsets) > 0
    inner = breaks + 1
    inner = inner[~np.isin(inner, offsets[1:])]
    start = np.sort(np.concatenate([offsets[:-1][some], inner]))
    text = np.searchsorted(offsets, start, side="right") - 1
    ends = np.append(breaks, len(codes))
    end = np.minimum(ends[np.searchsorted(breaks, start)], offsets[text + 1])
    number = np.arange(len(start)) - np.searchsorted(start, offsets[text])
    solid = np.flatnonzero(~_BLANK[np.minimum(codes, 127)])
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = lo < hi
    start, end = start.copy(), end.copy()
    start[full], end[full] = solid[lo[full]], solid[hi[full] - 1] + 1
    end[~full] = start[~full]
    return text, number, start, end


def _digests(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a cryptographic digest of each line, by which equal lines are one class."""
    raw = memoryview(codes.tobytes())
    both = b"".join(hashlib.blake2b(raw[4 * lo : 4 * hi], digest_size=16).digest() for lo, hi in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(both, np.int64).reshape(-1, 2)


def block_keys(roll: Plain, start: np.ndarray, end: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """(line, key, from, to): keys of each line less one block, and the hole that the block leaves.

    With block size S <= n / parts, an edit at p in block i = p // S (the last block takes the rest) leaves
    i * S characters before and (parts - 1 - i) * S after it in both lines.  Lengths differ by one at most,
    so each line uses the sizes for n - 1, n and n + 1, mostly one.
    """
    n = end - start
    size = [np.where((n + d) // parts > 0, _SIZES[np.searchsorted(_SIZES, np.maximum(1, (n + d) // parts), side="right") - 1], 0) for d in (-1, 0, 1)]
    out = []
    for k in range(3):
        r = np.flatnonzero((size[k] > 0) & ((parts - 1) * size[k] <= n) & ((size[k] != size[k - 1]) | (k == 0)))
        s = size[k][r]
        for i in range(parts):
            left, right = i * s, (parts - 1 - i) * s
            key = roll.joined(start[r], start[r] + left, end[r] - right, end[r]) + (s * 1009 + i).astype(np.uint64)
            out.append((r, key.view(np.int64), left, n[r] - right))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(4))


def _scanned(least: int, near: int, parts: int):
    """The lines that count, with hashes and, from `near` characters on, the keys of their halves, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for big in batches:
                for b in slices(big, "text"):
                    codes, offsets = _codes([t or "" for t in b.column(2).to_pylist()])
                    text, number, start, end = line_spans(codes, offsets)
                    long = end - start >= least
                    text, number, start, end = text[long], number[long], start[long], end[long]
                    roll, h = Plain(codes), _digests(codes, start, end)
                    far = np.flatnonzero(end - start >= near)
                    row, key, _, _ = block_keys(roll, start[far], end[far], parts)
                    row = far[row]
                    order = np.argsort(row, kind="stable")
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))])
                    keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[order]))
                    ids, ks = (b.column(k).to_numpy()[text] for k in (0, 1))
                    yield pa.record_batch({"id": ids, "k": ks, "n": number.astype(np.int32), "h1": h[:, 0].copy(), "h2": h[:, 1].copy(), "keys": keys})

    return run


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines (n, h1, h2) of each text."""
    for b in batches:
        h1, h2, found = [], [], []
        for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts = text.split("\n")
            for w in wanted:
                h1.append(w["h1"])
                h2.append(w["h2"])
                found.append(parts[w["n"]].strip(_STRIP))
        yield pa.record_batch({"h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "line": pa.array(found, pa.string())})


def _fine_keys(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for big in batches:
                for b in slices(big, "line"):
                    codes, offsets = _codes(b.column(2).to_pylist())
                    roll, start, end = Plain(codes), offsets[:-1], offsets[1:]
                    # two lines of which one has `parts` characters share the finer blocks; both are cut into these from parts - 1 on
                    cuts = []
                    for some, count in ((np.flatnonzero(end - start >= parts - 1), parts), (np.flatnonzero(end - start < parts), min(FEW, parts))):
                        r, *rest = block_keys(roll, start[some], end[some], count)
                        cuts.append((some[r], *rest))
                    r, key, lo, hi = (np.concatenate(x) for x in zip(*cuts, strict=True))
                    yield pa.record_batch({"h1": b.column(0).to_numpy()[r], "h2": b.column(1).to_numpy()[r], "key": key, "hole_from": lo.astype(np.int32), "hole_to": hi.astype(np.int32)})

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All variants of one deletion within the holes of a line, and the line itself as the target of deletions."""
    with np.errstate(over="ignore"):
        for big in batches:
            for b in slices(big, "line", 1 << 16):
                codes, offsets = _codes(b.column(2).to_pylist())
                roll = Rolling(codes)
                holes = b.column(3)
                span, owner = holes.flatten(), np.repeat(np.arange(b.num_rows), np.diff(holes.offsets.to_numpy()))
                lo, hi = (span.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                count = np.maximum(0, hi - lo)
                row = np.repeat(owner, count)
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                once = np.unique((row << 40) | place)
                row, place = once >> 40, once & ((1 << 40) - 1)
                at = offsets[row] + place
                n = np.diff(offsets)
                gone, whole = roll.joined(offsets[row], at, at + 1, offsets[row + 1]), roll.of(offsets[:-1], offsets[1:])
                all_rows = np.arange(b.num_rows)
                salt = lambda size: size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                deleted, own = gone + salt(n[row] - 1), whole + salt(n)
                substituted = (deleted ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
                r = np.concatenate([row, row, all_rows])
                kind = np.concatenate([np.zeros(len(row), np.int8), np.ones(len(row), np.int8), np.full(len(all_rows), 2, np.int8)])
                yield pa.record_batch({"h1": b.column(0).to_numpy()[r], "h2": b.column(1).to_numpy()[r], "variant": np.concatenate([substituted, deleted, own]).view(np.int64), "kind": kind})


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of (key, h1, ...) whose key different lines have."""
    shared = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key")
    return keys.join(shared, "key")


def repeated_lines(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, near: int = NEAR, parts: int = PARTS, edits: int = 1, work: Workspace | None = None) -> DataFrame:
    """(id, k, n): lines of docs (id, k, text) to be removed, edits being 0 (equal lines only) or 1, that for lines of `near` characters and more."""
    if edits not in (0, 1):
        raise ValueError("edits is 0 or 1")
    work = work or Workspace(spark, "lines")
    lines = work.put(docs.select("id", "k", "text").mapInArrow(_scanned(least, near, 2), SCANNED), "lines")
    place = F.struct("id", "k", "n")
    classes = work.put(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("many")), "classes")
    if edits:
        close = _shared(lines.select("h1", "h2", F.explode("keys").alias("key"))).select("h1", "h2").distinct()
        # each class's text is fetched once, from its earliest place
        places = classes.join(close, ["h1", "h2"]).groupBy(F.col("first.id").alias("id"), F.col("first.k").alias("k")).agg(F.collect_list(F.struct("first.n", "h1", "h2")).alias("wanted"))
        texts = work.put(docs.join(places, ["id", "k"]).select("text", "wanted").mapInArrow(_fetched, "h1 long, h2 long, line string").dropDuplicates(["h1", "h2"]), "texts")
        held = _shared(texts.mapInArrow(_fine_keys(parts), KEYS)).groupBy("h1", "h2").agg(F.collect_set(F.struct("hole_from", "hole_to")).alias("holes"))
        few = work.put(texts.join(held, ["h1", "h2"]).select("h1", "h2", "line", "holes"), "near-lines")
        variants = work.put(few.mapInArrow(_variants, "h1 long, h2 long, variant long, kind byte").join(classes.select("h1", "h2", "first"), ["h1", "h2"]), "variants")
        same_place = F.min(F.when(F.col("kind") == 0, F.struct("first", "h1", "h2")))
        shorter, longer = (F.min(F.when(F.col("kind") == k, F.struct("first", "h1", "h2"))) for k in (2, 1))
        groups = variants.groupBy("variant").agg(same_place.alias("same"), shorter.alias("whole"), longer.alias("less"), F.count("*").alias("c")).where("c > 1").drop("c")
        other = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("less"))
        best = variants.join(groups, "variant").withColumn("other", other).where("other.first < first").groupBy("h1", "h2").agg(F.min("other").alias("other"))
        line_of = few.select("h1", "h2", "line")
        pairs = best.join(line_of, ["h1", "h2"]).join(line_of.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other_line")), (F.col("other.h1") == F.col("o1")) & (F.col("other.h2") == F.col("o2")))
        verified = pairs.where(F.levenshtein("line", "other_line", edits) >= 0).select("h1", "h2", F.col("other.first").alias("near"))
        earliest = classes.select("h1", "h2", "first", "many").join(verified, ["h1", "h2"], "left").where("many > 1 or near is not null").select("h1", "h2", "first", "near")
    else:
        earliest = classes.where("many > 1").select("h1", "h2", "first", F.lit(None).cast(classes.schema["first"].dataType).alias("near"))
    done = work.put(earliest, "earliest")
    for table in (classes, *((texts, few, variants) if edits else ())):
        work.remove(table)
    work.sweep()
    found = lines.select("h1", "h2", "id", "k", "n").join(done, ["h1", "h2"])
    return found.where((place > F.col("first")) | F.col("near").isNotNull()).select("id", "k", "n")


def dedup(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, near: int = NEAR, edits: int = 1, emptied: str | None = None) -> DataFrame:
    """The rows of docs with repeated lines cut from the text, and n_removed, how many.

    Rows that lost lines and keep none that counts go, or, if `emptied` names a column for it, stay with an
    empty text and true there.
    """
    work = Workspace(spark, "lines")
    docs = docs.drop(*({"n_removed", emptied or "n_removed"} - {id_col, text_col}))
    key, k, gone, kept, full = own_names(docs, "_id", "_k", "_gone", "_kept", "_whole")
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), k: F.xxhash64(text_col)})
    plain = keyed.select(F.col(key).alias("id"), F.col(k).alias("k"), F.col(text_col).alias("text"))
    found = repeated_lines(spark, plain, least=least, near=near, edits=edits, work=work).groupBy(F.col("id").alias(key), F.col("k").alias(k)).agg(F.collect_set("n").alias(gone))
    cut = keyed.join(found, [key, k], "left")
    left = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i))
    out = cut.withColumn(kept, F.when(F.col(gone).isNotNull(), left))
    whole = F.col(gone).isNull() | F.exists(kept, lambda x: F.char_length(F.btrim(x, F.lit(_STRIP))) >= least)
    out = out.withColumns({text_col: F.when(F.col(gone).isNull(), F.col(text_col)).when(whole, F.array_join(kept, "\n")).otherwise(""), full: whole})
    out = out.where(F.col(full)) if emptied is None else out.withColumn(emptied, ~F.col(full))
    return out.withColumn("n_removed", F.coalesce(F.array_size(gone), F.lit(0)).cast("long")).drop(key, k, gone, kept, full)
