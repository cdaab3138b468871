"""MinHash near-dedup with tensored banding.

A document is the set of its distinct word shingles.  Two small collections of minhash tuples, A and B,
are computed; the key of table (i, j) joins tuple A_i with tuple B_j, so m + m tuples serve m * m
tables.  Equal sets are one class from the start.  Classes that share a table key are candidates and
every link is confirmed on the full sets.

A tuple of A that more than CROWD classes have would make m large tables of nearly the same classes; it is
a bucket by itself, which holds what its tables would hold.  Within a bucket, pairs are not enumerated.  A class's lone shingles, which no other candidate has, add to
any union and to no intersection; they bound its similarity with any partner and settle most classes that
only share a passage.  Buckets of up to SMALL classes are paired.  In larger ones each class is compared
with two hubs.  The links so found join most of a bucket into one group, and only classes of different
groups are compared further: by an exact prefix join, in which two classes must share one of their
rarest shingles, at places that leave enough behind, and have sizes near enough.  No class is dropped or
capped, and no pair within a group is formed.

Nulls and texts without words have the empty set and link with nothing.  Very long texts are sets like
others.  Repeated rows are equal sets, rows that repeat a doc_id count as one node, through whichever of
their texts it links, or with by_text=True each different text is a node of its own.  Rows with a null id
have their number of shingles, no component and are kept.  Of equal ids the tie goes to the text with the
smaller hash.  An empty table gives an empty result.  Columns besides the id and the text are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Workspace, components, mix, slices, utf8

#: Bytes that separate words: space and the controls from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Buckets of at most so many classes are paired at once; tuples of A that more classes have are not combined with those of B.
SMALL, CROWD = 12, 64


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text, its sorted distinct shingle hashes; fewer words than `width` make one shingle."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    data = _LOWER[data]
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (first[:-1] | ~before))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (first[1:] | ~after)) + 1
    hashes = Rolling(data).of(start, end)
    at = np.searchsorted(start, offsets)
    odd = [np.uint64(pow(0xA0761D6478BD642F, 2 * j + 1, 1 << 64)) for j in range(width)]
    whole = max(0, len(hashes) - width + 1)
    runs = np.zeros(whole, np.uint64)
    for j in range(width):
        runs += hashes[j : j + whole] * odd[j]
    runs = mix(runs)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(runs[lo : hi - width + 1].view(np.int64)).view(np.uint64))
        elif hi > lo:
            short = np.uint64(hi - lo)
            for j in range(lo, hi):
                short = short + hashes[j] * odd[j - lo]
            out.append(mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], m: int, rows: int, seed: int) -> np.ndarray:
    """2 m tuple hashes for each non-empty set: tuples 0..m-1 are collection A, the others B."""
    salt = mix(np.arange(1, 2 * 2 * m * rows + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32)))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begin = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), 2 * m), np.uint64)
    for t in range(2 * m):
        for r in range(rows):
            k = 2 * (t * rows + r)
            low = np.minimum.reduceat((flat ^ salt[k]) * (salt[k + 1] | np.uint64(1)), begin)
            out[:, t] = mix(out[:, t] + low + np.uint64(r + 1))
    return out


def _sketched(ids: str, width: int, m: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for big in batches:
                for b in slices(big, "text"):
                    sets = shingles(*utf8(b.column(1)), width)
                    some = [x for x in sets if len(x)]
                    sketch = iter(sketches(some, m, rows, seed)) if some else iter(())
                    yield pa.record_batch(
                        {
                            "id": b.column(0),
                            "k": b.column(2),
                            "n": pa.array([len(x) for x in sets], pa.int64()),
                            "fp": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                            "sketch": pa.array([next(sketch).view(np.int64) if len(x) else None for x in sets], pa.list_(pa.int64())),
                        }
                    )

    return run


def _as_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for big in batches:
                for b in slices(big, "text"):
                    yield pa.record_batch({"id": b.column(0), "items": pa.array([x.view(np.int64) for x in shingles(*utf8(b.column(1)), width)], pa.list_(pa.int64()))})

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs, ys = (b.column(k).values.to_numpy() for k in (2, 3))
        xo, yo = (b.column(k).offsets.to_numpy() for k in (2, 3))
        both, union = [], []
        for i in range(b.num_rows):
            z = np.concatenate([xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]])
            z.sort(kind="stable")  # merges the two sorted runs
            both.append(int(np.count_nonzero(z[1:] == z[:-1])))
            union.append(len(z) - both[-1])
        yield pa.record_batch({"a": b.column(0), "b": b.column(1), "both": pa.array(both, pa.int64()), "either": pa.array(union, pa.int64())})


def _linked(work: Workspace, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the candidate pairs that are links, on their full sets; sizes and lone shingles rule out some before the sets are fetched."""
    some = work.put(pairs.where(_may(percent)).select("a", "b").distinct(), "pairs")
    x = sets.select(F.col("id").alias("a"), F.col("items").alias("xs"))
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("ys"))
    # the sets are joined in one way at every size
    both = some.join(y.hint("merge"), "b").join(x.hint("merge"), "a").select("a", "b", "xs", "ys").mapInArrow(_overlap, "a long, b long, both long, either long")
    return work.put(both.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b"), "links")


def _may(percent: int, n: str = "n", u: str = "u", n2: str = "n2", u2: str = "u2") -> Column:
    """Whether a pair may be a link, by sizes and lone shingles: |x & y| <= least n - u, and |x | y| = n + n2 - |x & y|."""
    return (100 + percent) * F.least(F.col(n) - F.col(u), F.col(n2) - F.col(u2)) >= percent * (F.col(n) + F.col(n2))


def _buckets(members: DataFrame) -> DataFrame:
    """(key, size) of buckets of two and more, one key for those with the same members: tables often agree."""
    found = members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lead"), F.bit_xor(F.xxhash64("id")).alias("members")).where("size > 1")
    return found.groupBy("size", "lead", "members").agg(F.min("key").alias("key")).select("key", "size")


def _pairs_of(members: DataFrame) -> DataFrame:
    """Candidate pairs: all within buckets of SMALL members at most."""
    x, y = members.select("key", F.col("id").alias("a"), "n", "u"), members.select("key", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("u").alias("u2"))
    return x.join(y, "key").where("a < b").select("a", "b", "n", "n2", "u", "u2")


def _with_hubs(crowded: DataFrame) -> DataFrame:
    """Candidate pairs of each member of a large bucket with its hubs: the one with fewest lone shingles, of these that in the largest buckets, and one by hash."""
    weight = crowded.groupBy("id").agg(F.sum("size").alias("weight"))
    me = F.struct("id", "n", "u")
    picks = [F.max_by(me, F.struct(-F.col("u"), "weight", -F.col("id"))), F.min_by(me, F.xxhash64("id", F.lit(1)))]
    hubs = crowded.join(weight, "id").groupBy("key").agg(F.array(*picks).alias("hubs")).select("key", F.explode(F.array_distinct("hubs")).alias("hub"))
    met = crowded.join(hubs, "key").where("id <> hub.id")
    first = F.col("id") < F.col("hub.id")
    return met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"), F.when(first, F.col("n")).otherwise(F.col("hub.n")).alias("n"), F.when(first, F.col("hub.n")).otherwise(F.col("n")).alias("n2"), F.when(first, F.col("u")).otherwise(F.col("hub.u")).alias("u"), F.when(first, F.col("hub.u")).otherwise(F.col("u")).alias("u2")).distinct()


def _across(work: Workspace, rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, n, n2, u, u2) of different groups among rest (id, n, grp), by an exact prefix join.

    Shingles are ordered by how many of rest have them, rare ones first.  A link shares at least
    percent * n of a set of n, so one of its first n - least + 1 shingles; and with the first shared one at
    places i and j (from 0), at most least(n - i, n2 - j) in all.
    """
    items = sets.join(rest.select("id"), "id", "left_semi").select("id", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("df"))
    ranked = items.join(often, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("l"))  # as many as the set has
    prefix = F.slice("l", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    alone = F.size(F.filter("l", lambda x: x["df"] == 1)).cast("long")
    placed = ranked.join(rest, "id").select("id", "n", "grp", alone.alias("u"), F.posexplode(prefix).alias("at", "s"))
    tokens = work.put(placed.where("s.df > 1").select(F.col("s.item").alias("item"), "id", "n", "grp", "u", "at"), "prefixes")
    # of an item's groups the largest is compared with the others only
    groups = tokens.groupBy("item", "grp").agg(F.count("*").alias("c")).groupBy("item").agg(F.max_by("grp", F.struct("c", "grp")).alias("most"), F.count("*").alias("groups")).where("groups > 1").select("item", "most")
    marked = tokens.join(groups, "item")
    x = marked.where("grp <> most").select("item", F.col("id").alias("x"), F.col("grp").alias("g"), "n", "u", "at")
    y = marked.select("item", F.col("id").alias("y"), F.col("grp").alias("g2"), F.col("n").alias("n2"), F.col("u").alias("u2"), F.col("at").alias("at2"), (F.col("grp") == F.col("most")).alias("in_most"))
    enough = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= percent * (F.col("n") + F.col("n2"))
    met = x.join(y, "item").where("g <> g2").where(F.col("in_most") | (F.col("x") < F.col("y"))).where(enough & _may(percent))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("n")).otherwise(F.col("n2")).alias("n"), F.when(F.col("x") < F.col("y"), F.col("n2")).otherwise(F.col("n")).alias("n2"), F.when(F.col("x") < F.col("y"), F.col("u")).otherwise(F.col("u2")).alias("u"), F.when(F.col("x") < F.col("y"), F.col("u2")).otherwise(F.col("u")).alias("u2"))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, m: int = 8, rows: int = 2, seed: int = 1, by_text: bool = False, work: Workspace | None = None
) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (smallest id reachable by links), kept.

    Links join sets with 100 * intersection >= percent * union.  At a similarity of 0.85 the defaults
    miss a candidate with probability 2 * (1 - 0.85**rows)**m, below 1 in 14,000, less above it.

    With by_text, rows of one id are no link between their texts, kept marks one id and text of each component,
    and text_key, the text's xxhash64, tells which text of an id a row has.
    """
    work = work or Workspace(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k"))
    sigs = work.put(texts.mapInArrow(_sketched("id", width, m, rows, seed), "id long, k long, n long, fp binary, sketch array<long>"), "sketches")
    first = F.min_by(F.struct(F.col("id").alias("doc"), "k", "n", "sketch"), F.struct("id", "k")).alias("c")
    # numbers of classes are fixed by the written table
    classes = work.put(sigs.where("fp is not null and id is not null").groupBy("fp").agg(first).select("fp", "c.*").withColumn("id", F.monotonically_increasing_id()), "classes")
    # a tuple that no other class has cannot be half of a shared key
    half = classes.select("id", "doc", "k", "n", F.posexplode("sketch").alias("t", "h"))
    shared = half.groupBy("t", "h").agg(F.count("*").alias("c")).where("c > 1").select("t", "h")
    chosen = work.put(half.join(shared.hint("merge"), ["t", "h"]).groupBy("id", "doc", "k", "n").agg(F.collect_set(F.struct("t", "h")).alias("l")), "halves")  # 2 m at most
    # the texts are joined in one way at every size; equal rows are one text, found in the join's own order
    wanted = chosen.select(F.col("doc").alias("wanted_doc"), F.col("k").alias("wanted_k"), F.col("id").alias("class"))
    fetched = texts.join(wanted.hint("merge"), (F.col("id") == F.col("wanted_doc")) & (F.col("k") == F.col("wanted_k"))).dropDuplicates(["id", "k"])
    sets = work.put(fetched.select(F.col("class").alias("id"), "text").mapInArrow(_as_sets(width), "id long, items array<long>"), "sets")
    # shingles that no other set has; classes of which too much is their own can link with none
    lone = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").groupBy("id").agg(F.count("*").alias("u"))
    sized = chosen.select("id", "n", "l").join(lone, "id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    able = work.put(sized.where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n")), "able")
    work.sweep()
    # tuples of A that few classes have are combined with those of B; one that many have is a bucket as it is, not m of them
    in_a, in_b = (F.filter("l", lambda x: x["t"] < m), F.filter("l", lambda x: x["t"] >= m))
    tuples = able.select("id", "n", "u", in_b.alias("in_b"), F.explode(in_a).alias("a")).select("id", "n", "u", "in_b", "a.t", "a.h")
    sizes = tuples.groupBy("t", "h").agg(F.count("*").alias("of_a")).where("of_a > 1")
    met = work.put(tuples.join(sizes, ["t", "h"]), "tuples")
    cells = F.explode(F.transform("in_b", lambda y: F.xxhash64("t", y["t"], "h", y["h"])))
    tables = met.where(F.col("of_a") <= CROWD).select(cells.alias("key"), "id", "n", "u")
    wide = met.where(F.col("of_a") > CROWD).select(F.xxhash64("t", "h").alias("key"), "id", "n", "u")
    keys = tables.union(wide)
    members = work.put(keys.join(_buckets(keys), "key"), "members")
    work.remove(met)
    sets = work.put(sets.join(able.select("id").hint("merge"), "id", "left_semi"), "able-sets")
    crowded = members.where(F.col("size") > SMALL)
    links = _linked(work, _pairs_of(members.where(F.col("size") <= SMALL)).union(_with_hubs(crowded)), sets, percent)
    if not by_text:  # texts of one id are linked by it
        held = sigs.where("fp is not null and id is not null").select(F.col("id").alias("doc"), "fp")
        several = held.groupBy("doc").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc", "lo")
        ends = [classes.select(F.col("id").alias(a), F.col("fp").alias(on)) for a, on in (("a", "lo"), ("b", "fp"))]
        links = links.union(held.join(several, "doc").where("fp <> lo").join(ends[0], "lo").join(ends[1], "fp").select("a", "b"))
    groups = components(work, links)
    grouped = crowded.join(groups.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    torn = grouped.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("key")
    rest = work.put(grouped.join(torn, "key").select("id", "n", "grp").distinct(), "rest")
    later = _linked(work, _across(work, rest, sets, percent), sets, percent)
    ends = [groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_grp")) for c in ("a", "b")]
    between = later.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_grp", "a").alias("a"), F.coalesce("b_grp", "b").alias("b"))
    joined = components(work, between).select(F.col("node").alias("grp"), F.col("component").alias("whole"))
    named = classes.select("fp", "doc", "k", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("grp", F.coalesce("component", "id"))
    named = named.join(joined, "grp", "left").select("fp", "doc", "k", F.coalesce("whole", "grp").alias("component"))
    least = named.groupBy("component").agg(F.min(F.struct("doc", "k")).alias("least"))
    out = sigs.select("id", "k", "n", "fp").join(named.select("fp", "component"), "fp", "left").join(least, "component", "left")
    component = F.coalesce("least.doc", "id")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    result = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")]
    if not by_text:
        return out.select(*result, kept.alias("kept"))
    return out.select(*result, (kept & (F.col("id").isNull() | F.coalesce(F.col("k") == F.col("least.k"), F.lit(True)))).alias("kept"), F.col("k").alias("text_key"))
