"""Best-fit packing into sequences of several permitted lengths.

Rows are dealt by a hash into shards of about `shard_words` words, so that each shard's packing is one
task's bounded work and no group grows with the input.  In a shard, pieces go in order of falling size
into the open bin with least room that holds them.  If none does, a bin opens.  For every permitted length
it is worked out how far the pieces that are left would fill it, largest first, and the length with the
least cost per word opens.  A sequence costs its length, `overhead` words for being one, and, as attention
grows with the square, length**2 / `square` more; so short pieces share short bins where these fill up, and
a longer one opens where what is left would leave holes.  In the end each bin shrinks to the smallest
permitted length that holds its contents.

A text longer than the longest length is cut into pieces of that length and a rest; every word of every
row is placed exactly once.  Null and empty texts and those without words are placed nowhere, and an empty
table gives an empty result.  A null id is an id of its own.  Rows that repeat an id are packed on their own;
equal rows are told apart by a number, so that the shards and bins depend on the rows only, not on their files.  Of
equal sizes the smaller id goes first, of equal rooms the bin that got it last is taken, of equal costs the
shorter length.  Columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .mixing import words

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD, SQUARE = 16, 8192
SHARD_WORDS = 1 << 21

PLACED = "bin string, capacity long, filled long, slot long, doc_id long, piece long, start long, length long"


def cost(length: int, overhead: int = OVERHEAD, square: float = SQUARE) -> float:
    """What a sequence of a permitted length costs."""
    return length + overhead + length * length / square


def _fill(capacity: int, sizes: list[int], counts: dict[int, int]) -> int:
    """Words that a bin holds if it takes the largest of the pieces that are left, over and over; sizes ascend."""
    room, at = capacity, len(sizes)
    while at := bisect.bisect_right(sizes, room, 0, at):
        size = sizes[at - 1]
        room -= size * min(counts[size], room // size)
        at -= 1
    return capacity - room


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, square: float = SQUARE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """((bin, offset) of each size, (capacity, filled) of each bin); sizes are 1 to the longest length."""
    lengths = tuple(sorted(lengths))
    price = {c: cost(c, overhead, square) for c in lengths}
    counts = Counter(sizes)
    left = sorted(counts)  # distinct sizes that are left, ascending
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    bins: list[list[int]] = []  # [capacity, filled]
    where: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[k]
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
        else:
            filled = {c: _fill(c, left, counts) for c in lengths if c >= size}
            # a bin that is not filled shrinks in the end
            room = min(filled, key=lambda c: (price[lengths[bisect.bisect_left(lengths, filled[c])]] / filled[c], c))
            b = len(bins)
            bins.append([room, 0])
        where[k] = (b, bins[b][1])
        bins[b][1] += size
        counts[size] -= 1
        if not counts[size]:
            left.pop()  # sizes fall, so it is the largest
        if rest := room - size:
            if rest not in open_bins:
                bisect.insort(rooms, rest)
                open_bins[rest] = []
            open_bins[rest].append(b)
    return where, [(lengths[bisect.bisect_left(lengths, filled)], filled) for _, filled in bins]


def _packed(lengths: tuple[int, ...], overhead: int, square: float):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = sorted(zip(*(table.column(k).to_pylist() for k in ("id", "size")), strict=True), key=lambda r: (r[0] is None, r))
        longest = max(lengths)
        pieces = [(doc, n, at, min(longest, size - at)) for doc, size in rows for n, at in enumerate(range(0, size, longest))]
        where, bins = best_fit([p[3] for p in pieces], lengths, overhead, square)
        order: dict[int, int] = {}
        out = []
        for (doc, n, at, size), (b, offset) in zip(pieces, where, strict=True):
            order[b] = order.get(b, -1) + 1
            out.append((f"{shard}-{b}", bins[b][0], bins[b][1], offset, doc, n, at, size))
        names = ("bin", "capacity", "filled", "slot", "doc_id", "piece", "start", "length")
        return pa.table([pa.array(c, pa.string() if n == "bin" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], list(names))

    return run


def pack(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, square: float = SQUARE, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """One row per piece: its bin, the bin's capacity and contents, its offset there, and which words of which row it is."""
    work = Workspace(spark, "packing")
    sized = docs.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("h")).where("size > 0")
    # copies of one row differ in nothing, so a hash alone would put them all into one shard: they are counted and numbered
    counted = work.put(sized.groupBy("id", "size", "h").agg(F.count("*").alias("copies")), "sizes")
    total = counted.agg(F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-total // shard_words))
    each = counted.select("id", "size", "h", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    dealt = each.select("id", "size", F.pmod(F.xxhash64("h", "copy"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(_packed(lengths, overhead, square), PLACED)


def check(placed: Iterator[tuple], lengths: tuple[int, ...] = LENGTHS) -> None:
    """Raises ValueError unless (bin, capacity, filled, slot, length) rows tile their bins without gaps."""
    by: dict[str, list] = {}
    for name, capacity, filled, slot, length in placed:
        by.setdefault(name, []).append((slot, length, capacity, filled))
    for name, parts in by.items():
        at = 0
        for slot, length, capacity, filled in sorted(parts):
            if slot != at or capacity not in lengths or capacity != min(c for c in lengths if c >= filled):
                raise ValueError(f"bin {name} is not whole")
            at += length
        if at != parts[0][3]:
            raise ValueError(f"bin {name} holds {at}")
