"""Suffix-array dedup: removal of byte strings of a least length that also start elsewhere.

Every window of `length` bytes belongs to the least hash among its `gram`-byte substrings.  Maximal runs
of window starts with the same least hash are the records; equal windows have equal least hashes, so
only records that share one can match, and a record whose hash is met nowhere else is settled at once.
Records of equal text, by a cryptographic digest, stand for one another.  The distinct texts that share a
hash are put into suffix order together, ties by position.  There the previous smaller position of a
suffix, among those that agree with it in `length` bytes, is its neighbour before it: its longest previous
factor is long enough exactly if that neighbour is in its class, and the neighbour is its earlier match.

A hash with more than GROUP distinct texts never meets in one task: its windows are counted by 124 bits of
two independent rolling hashes, in an aggregate with map-side partials.  Documents are joined by id (null: last) and
a hash of the text; rows that repeat an id with other texts, or have no id, are documents of their own, and rows that
repeat id and text are copies of each other.  Null texts are empty, and empty or short ones have no windows.  Texts longer
than a slice are taken in pieces that overlap by a window.  Of equal strings the first is the one with the least (id, hash, place).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Rolling, Workspace, mix, slices, utf8

#: Distinct texts of one hash that are sorted in one task; beyond it windows are counted by hash.
GROUP = 2000
#: Bytes of whole groups that are put into suffix order at once: few, so that ranks stay in caches.
SORT_BYTES = 1 << 16

#: Base of the gram hashes, modulo 2**64.  They only say which records are compared: equal grams agree, and others that do cost time.
GRAM_BASE = 0x5851F42D4C957F2D

RECORD = "k1 long, k2 long, h long, t binary, s long, e long, again boolean"
INTERVAL = "k1 long, k2 long, s long, e long, other boolean"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` bytes, by doubling: hashes of runs of 2**k bytes, then of two that overlap."""
    h, span = data.astype(np.uint64) + np.uint64(1), 1
    while span * 2 <= gram:
        h = h[:-span] * np.uint64(pow(GRAM_BASE, span, 1 << 64)) + h[span:]
        span *= 2
    n = len(data) - gram + 1
    if span < gram:
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[gram - span : gram - span + n]
    return mix(h)


def window_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` values, the one with the least upper half and its position, leftmost of equals."""
    n = len(values) - width + 1
    low = np.uint64(0xFFFFFFFF)
    best = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[:n], best[width - span : width - span + n])
    at = (best[:n] & low).astype(np.int64)
    return values[at], at


def allowed_starts(offsets: np.ndarray, within: list[list[dict] | None], length: int, moved: int) -> np.ndarray:
    """Whether a window of `length` bytes at each byte lies within one of its text's spans; `moved` bytes of the first text are cut off."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    for at, found in zip(offsets[:-1].tolist(), within, strict=True):
        lo, hi = _merged(found)
        lo, hi = np.maximum(lo - moved, 0), hi - moved - length + 1
        some = hi > lo
        np.add.at(edge, np.minimum(at + lo[some], len(edge) - 1), 1)
        np.add.at(edge, np.minimum(at + hi[some], len(edge) - 1), -1)
    return np.cumsum(edge[:-1]) > 0


def records(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, within: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs of window starts with one least hash: row, start, end (of the last window), h, t (digest of the text), again."""
    if not (np.diff(offsets) >= length).any():
        return {}
    least, at = window_least(gram_hashes(data, gram), length - gram + 1)
    row = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    whole = offsets[row + 1] - np.arange(len(least)) >= length
    starts = np.flatnonzero(whole if within is None else whole & within[: len(whole)])
    if not len(starts):
        return {}
    least, at, row = least[starts], at[starts], row[starts]
    new = np.empty(len(starts), bool)
    new[0], new[1:] = True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    moved = np.concatenate([[0], np.cumsum((at[1:] != at[:-1]) & ~new[1:])])
    s, e = starts[begin], starts[last] + length
    raw = memoryview(data.tobytes())
    digests = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
    return {"row": row[begin], "s": s - offsets[row[begin]], "e": e - offsets[row[begin]], "h": least[begin], "t": digests, "again": moved[last] > moved[begin]}


def _records(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for big in batches:
                for b in slices(big, "text"):
                    data, offsets = utf8(b.column(2))
                    within = b.column(3).to_pylist() if b.num_columns > 3 else None
                    # a longer text is taken in pieces that overlap in all but one byte of a window
                    step = max(2 * SLICE_BYTES, len(data) if b.num_rows > 1 else 0)
                    for at in range(0, max(1, len(data) - length + 1), step):
                        piece = data[at : at + step + length - 1]
                        ends = offsets if len(piece) == len(data) else np.array([0, len(piece)])
                        if r := records(piece, ends, length, gram, None if within is None else allowed_starts(ends, within, length, at)):
                            keys = [b.column(k).to_numpy()[r["row"]] for k in (0, 1)]
                            pa.default_memory_pool().release_unused()
                            yield pa.record_batch({"k1": keys[0], "k2": keys[1], "h": r["h"].view(np.int64), "t": pa.array(r["t"], pa.binary()), "s": r["s"] + at, "e": r["e"] + at, "again": r["again"]})

    return run


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, new): stable order of the keys, dense rank of each, and where a new key begins in the order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1], new[1:] = True, ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank, new


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `starts` by their first `length` bytes, ties by position; and where a new class begins.

    Ranks by 8 bytes are doubled up to the length.  Every start must have `length` bytes behind it.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros(len(text), np.uint64)
    depth = min(8, length)
    for j in range(depth):
        keys = (keys << np.uint64(8)) | padded[j : j + len(text)]
    while depth < length:
        step = min(depth, length - depth)
        _, rank, _ = _ranked(keys)
        follow = np.zeros(len(text), np.int64)
        follow[: len(text) - step] = rank[step:] + 1
        keys = rank * (len(text) + 1) + follow
        depth += step
    order, _, new = _ranked(keys[starts])
    return order, new


def matches(text: np.ndarray, starts: np.ndarray, length: int, owner: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start, the nearest earlier and later one whose next `length` bytes are equal (else -1), and whether these have several owners or one that stands for several.

    In suffix order with ties by position, the neighbours of a suffix within its class are these: the one
    before is its previous smaller position, so its longest previous factor reaches `length` exactly if there is one.
    """
    order, new = suffix_order(text, starts, length)
    at = starts[order]
    earlier, later, other = (np.full(len(starts), -1), np.full(len(starts), -1), np.zeros(len(starts), bool))
    again = np.flatnonzero(~new)
    earlier[order[again]] = at[again - 1]
    later[order[again - 1]] = at[again]
    begin = np.flatnonzero(new)
    mine = owner[order]
    if len(begin):
        several = (np.minimum.reduceat(mine, begin) < np.maximum.reduceat(mine, begin)) | np.maximum.reduceat(shared[order], begin)
        other[order] = np.repeat(several, np.diff(np.append(begin, len(order))))
    return earlier, later, other


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the intervals, in order of their starts, cover; touching runs are one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.append(new[1:], len(starts)) - 1]


def _merged(found: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """spans() of a list of (s, e) in any order."""
    s, e = (np.array([x[k] for x in found or ()], np.int64) for k in ("s", "e"))
    by = np.argsort(s, kind="stable")
    return spans(s[by], e[by])


def _sorted_groups(length: int, earlier_only: bool):
    """Segments come sorted by hash and place: whole groups are put into suffix order, several at a time."""

    def solve(parts: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(p[4]) for p in parts])
        base = np.cumsum([0, *sizes])
        text = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
        documents: dict[tuple, int] = {}
        owner = np.array([documents.setdefault(p[1:3], len(documents)) for p in parts])
        count = sizes - length + 1
        which = np.repeat(np.arange(len(parts)), count)
        first = np.cumsum(count) - count
        inside = np.arange(int(count.sum())) - first[which]
        shared = np.array([p[5] for p in parts])
        earlier, later, other = matches(text, base[which] + inside, length, owner[which], shared[which])
        out = {"k1": [], "k2": [], "s": [], "e": [], "other": []}
        for kind in (False, True):
            hit = np.flatnonzero(((earlier >= 0) | ((later >= 0) & (not earlier_only))) & (other == kind))
            s = base[which[hit]] + inside[hit]
            # a gap of one byte between parts keeps runs of different segments apart
            lo, hi = spans(s + which[hit], s + which[hit] + length)
            part = np.searchsorted(base[:-1] + np.arange(len(parts)), lo, side="right") - 1
            for a, b, k in zip(lo.tolist(), hi.tolist(), part.tolist(), strict=True):
                at = int(base[k]) + k
                for name, v in zip(out, (parts[k][1], parts[k][2], parts[k][3] + a - at, parts[k][3] + b - at, kind), strict=True):
                    out[name].append(v)
        return pa.record_batch({k: pa.array(v, pa.bool_() if k == "other" else pa.int64()) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for h, k1, k2, s, seg, shared in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if held and (h, k1, k2, s) == held[-1][:4]:
                    continue  # the row of a document occurs twice
                if h != last and size > SORT_BYTES:
                    yield solve(held)
                    held, size = [], 0
                held.append((h, k1, k2, s, seg, shared))
                size, last = size + len(seg), h
        if held:
            yield solve(held)

    return run


def _windows(length: int):
    """Two hashes of every window of the segments of crowded groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for big in batches:
                for b in slices(big, "seg"):
                    data, offsets = utf8(b.column(4))
                    count = np.diff(offsets) - length + 1
                    which = np.repeat(np.arange(len(count)), count)
                    inside = np.arange(int(count.sum())) - (np.cumsum(count) - count)[which]
                    at = offsets[which] + inside
                    one, two = Rolling(data), Rolling(data, 1)
                    keys = [b.column(k).to_numpy()[which] for k in (1, 2)]
                    yield pa.record_batch({"w1": one.of(at, at + length).view(np.int64), "w2": two.of(at, at + length).view(np.int64), "k1": keys[0], "k2": keys[1], "s": b.column(3).to_numpy()[which] + inside, "other": b.column(5).to_numpy(zero_copy_only=False)[which]})

    return run


def repeated_intervals(spark: SparkSession, docs: DataFrame, *, length: int = 400, gram: int = 96, keep: str = "none", work: Workspace | None = None) -> DataFrame:
    """(k1, k2, s, e, other): byte intervals of documents (k1, k2, text) covered by strings of `length` that start elsewhere too.

    keep="none" marks every copy, keep="first" all but the first, by id and place: the longest
    previous factor alone.  other tells whether the strings start in another document.  A column
    within, if docs has it, lists (s, e) spans outside of which nothing is searched.
    """
    earlier = keep == "first"
    work = work or Workspace(spark, "suffix")
    found = work.put(docs.mapInArrow(_records(length, gram), RECORD), "records")
    shared = found.groupBy("h").agg(F.count("*").alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("h")
    cand = work.put(found.join(shared, "h"), "candidates")
    work.remove(found)
    place, owner = F.struct("k1", "k2", "s", "e"), F.struct("k1", "k2")
    texts = work.put(cand.groupBy("h", "t").agg(F.count("*").alias("n"), F.min(place).alias("p"), F.max("again").alias("again"), (F.min(owner) < F.max(owner)).alias("other")), "texts")
    size = F.sum(F.when(F.col("other"), 1).otherwise(F.col("n")))
    groups = texts.groupBy("h").agg(size.alias("g"), F.max("again").alias("any"), F.min(F.col("other").cast("int")).alias("others")).where("(g > 1 and others = 0) or any" if not earlier else "g > 1 or any").select("h", "g")
    # copies of a whole record are repeats in all their windows; those within one document may still have others elsewhere
    copies = work.put(cand.join(texts.where("n > 1").select("h", "t", "p", "other"), ["h", "t"]).select("h", "k1", "k2", "s", "e", "p", "other"), "copies")
    work.remove(cand)
    settled = copies.where(place != F.col("p")) if earlier else copies
    alone = texts.where("n = 1 or other").select("h", "p.*", "other").union(copies.where("not other").select("h", "k1", "k2", "s", "e", "other"))
    open_texts = alone.join(groups, "h")
    segment = F.expr("substring(cast(text as binary), cast(s + 1 as int), cast(e - s as int))").alias("seg")
    segs = work.put(open_texts.join(docs.select("k1", "k2", "text"), ["k1", "k2"]).select("h", "k1", "k2", "s", segment, "other", "g"), "segments")
    few = segs.where(F.col("g") <= GROUP).drop("g").repartition("h").sortWithinPartitions("h", "k1", "k2", "s")
    ordered = few.mapInArrow(_sorted_groups(length, earlier), INTERVAL)
    crowded = segs.where(F.col("g") > GROUP).drop("g").mapInArrow(_windows(length), "w1 long, w2 long, k1 long, k2 long, s long, other boolean")
    windows = crowded.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "s")).alias("p"), (F.max("other") | (F.min(owner) < F.max(owner))).alias("other")).where("c > 1").select("w1", "w2", "p", "other")
    hits = crowded.drop("other").join(windows, ["w1", "w2"])
    if earlier:
        hits = hits.where(F.struct("k1", "k2", "s") != F.col("p"))
    return settled.select("k1", "k2", "s", "e", "other").union(ordered).union(hits.select("k1", "k2", "s", (F.col("s") + length).alias("e"), "other"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "n_shared": [], "kept": []}
        for text, found, passages in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            raw = text.as_buffer()
            raw = memoryview(raw) if raw is not None else memoryview(b"")
            lo, hi = _merged(found)
            at, kept = 0, []
            for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:])
            begin, end = _merged([p for p in passages or () if p["other"]])
            for name, v in zip(out, (len(raw), int((hi - lo).sum()), len(lo), int((end - begin).sum()), b"".join(kept)), strict=True):
                out[name].append(v)
        yield pa.record_batch({"id": b.column(0), **{k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()}})


def remove_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int = 256, keep: str = "none") -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, n_shared, kept (the remaining bytes, binary).

    Strings are judged on the input; a cut may split a character, therefore the rest is bytes.  n_shared
    counts the bytes covered by strings of `passage` bytes, at most `length`, that start in another document
    too: passages of about fifty words.  Repeats of that length are found over all texts; whatever repeats in
    `length` bytes lies within them, so these are searched only there.  Input columns other than id and text
    are ignored, whatever their names.  An empty table gives an empty result.
    """
    if not 8 <= passage <= length:
        raise ValueError("passage is 8 to length")
    work = Workspace(spark, "suffix")
    ids = F.col(id_col).cast("long").alias("id")
    texts = docs.select(ids, F.col(text_col).alias("text")).select("id", F.coalesce("id", F.lit((1 << 63) - 1)).alias("k1"), F.xxhash64("text", "id").alias("k2"), "text")
    gram = max(4, passage // 4)
    short = work.put(repeated_intervals(spark, texts.select("k1", "k2", "text"), length=passage, gram=gram, work=work), "passages")
    work.sweep()
    per_doc = work.put(short.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e", "other")).alias("passages"), (F.max("e") - F.min("s")).alias("reach")), "spans")
    within = work.put(texts.select("k1", "k2", "text").join(per_doc.where(F.col("reach") >= length).select("k1", "k2", F.col("passages").alias("within")), ["k1", "k2"]), "repeating")
    long = repeated_intervals(spark, within, length=length, gram=gram, keep=keep, work=work)
    found = long.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("found"))
    cut = texts.join(per_doc.join(found, ["k1", "k2"], "left").select("k1", "k2", "found", "passages"), ["k1", "k2"], "left").select("id", F.col("text").cast("binary").alias("text"), "found", "passages")
    out = cut.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary")
    return out.withColumnRenamed("id", id_col)


def kept_digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result with the SHA-256 of the remaining bytes in place of the bytes, and whether another document has a passage of it."""
    return removed.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared", (F.col("n_shared") > 0).alias("shared"))


def brute_force(texts: list[bytes], length: int, *, earlier: bool = False) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, sha256 of the rest) of each text, by a table of all windows; for small inputs."""
    seen: dict[bytes, int] = {}
    for x in texts:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    out, before = [], set()
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            if (w in before) if earlier else seen[w] > 1:
                gone[i : i + length] = b"\1" * length
            before.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out
