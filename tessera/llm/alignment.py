"""Alignment of two tokenizers by segment deduplication.

A byte-level BPE (A) and a piece model (B) encode every text.  A text is cut before runs of spaces, behind characters
for which both vocabularies prove that no token holds such a character and a space after it; A's own splitting
of words ends there as well.  So no merge crosses a cut, and the tokens of a text are those of its segments, one after
another.  Each distinct segment of the corpus is encoded and aligned once.

Texts are dealt into blocks of bounded size.  A block holds each of its segments once and its texts as numbers of these,
so what is shuffled is one row for each distinct segment of a block, not for each word: first to where equal segments of all
blocks meet, then with its alignment back to the block, where texts are composed.  Where a pair of ids is linked, how often it is linked corpus-wide, and which pair is
its A id's most frequent one, is counted from blocks, and comes back to them by pair; sums over links are then added up by segment.

Tokens of both sides are cut into groups where both end at the same byte; all A and B tokens of a group are linked.  A null
or empty text has no tokens, and neither has one whose tokens do not spell it (as with U+2581, which B reads as a space): zeros
and an empty digest, and nothing of it is counted.  A text without spaces is one segment, however long.  Rows that repeat an id
or a whole row are documents of their own, and count one by one.  A null id is an id like others.  An empty table gives an empty
result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

FOLDER = "/opt/tokenizers"
#: B's mark of a space; characters of texts that make a block (a longer text is one by itself); segments encoded at once.
MARK, BLOCK, BATCH = "▁", 12 << 20, 4096
#: Blocks of a task, as a power of two.
PER_TASK = 13


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 ones stand for themselves, the others for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies(NamedTuple):
    """The contents of both tokenizers' files, so that executors need no copy of them."""

    a: str
    b: bytes

    @classmethod
    def read(cls, a_path: str = f"{FOLDER}/byte_bpe_50k.json", b_path: str = f"{FOLDER}/piece_bpe_32k.model") -> Vocabularies:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    def open(self) -> Encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_str(self.a), sentencepiece.SentencePieceProcessor(model_proto=self.b)
        a.encode_special_tokens = True
        letters = byte_letters()
        entries = a.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in a.get_added_tokens_decoder().items()}
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            a_bytes[i] = added[i].encode() if i in added else bytes(letters[c] for c in entry)
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode() for i in range(b.get_piece_size())]
        return Encoders(a, b, a_bytes, b_bytes)


class Encoders(NamedTuple):
    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    def ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of a space and each segment, in A and in B, which adds the space itself, though not before nothing."""
        both = self.a.encode_batch_fast([f" {x}" for x in segments], add_special_tokens=False)
        alone = [self.b.piece_to_id(MARK)]
        return [x.ids for x in both], [y if s else alone for y, s in zip(self.b.encode(segments, num_threads=1), segments, strict=True)]


def cut_pattern(vocabularies: Vocabularies) -> str:
    """A pattern of the spaces before which texts may be cut, read off both vocabularies; ValueError if they allow no proof."""
    spec = json.loads(vocabularies.a)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or spec["model"].get("dropout"):
        raise ValueError("A must be a byte-level BPE without normalizer that splits words itself")
    enc = vocabularies.open()
    if "".join(enc.b.encode("a  b ", out_type=str)) != f"{MARK}a{MARK}{MARK}b{MARK}":
        raise ValueError("B must keep all spaces and add one")
    # characters that an entry holds before a space; parts of characters count as any that ends in that byte
    chars, ends = set(), set()
    for entry in [*enc.a_bytes, *enc.b_bytes]:
        for part in entry.split(b" ")[:-1]:
            if part:
                last = part.decode("utf-8", "replace")[-1]
                (ends.add(part[-1]) if last == "�" else chars.add(last))
    if any(x < 128 or x >= 192 for x in ends):
        raise ValueError("an entry ends in half a character before a space")
    chars |= {c for x in ends for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)]) if c.encode()[-1] == x}
    # white space of any kind is no place to cut behind: the run of spaces would be cut in two
    return f"(?<=[^\\s{MARK}{re.escape(''.join(sorted(c for c in chars if not c.isspace())))}]) "


def packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2**31, compressed: all first bytes, then all second ones and so on, as the high ones are alike."""
    planes = np.ascontiguousarray(x, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.int32(len(x)).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


class Numbers(dict):
    """Numbers for keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _blocks(pattern: str, size: int):
    """Rows (block, id, places): texts as places in their block's segments, and for each block a row with these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block, there = re.compile(pattern), TaskContext.get().partitionId() << PER_TASK, 0
        kept = re.compile(pattern.replace("(?<=[^", "(?:^|[", 1).replace("])", "])", 1))  # a space that is no place to cut at
        ids, places, known = [], [], Numbers()

        def done() -> pa.RecordBatch:
            n = len(ids)
            return pa.record_batch(
                {
                    "block": pa.array([block] * (n + 1), pa.int64()),
                    "id": pa.array([*ids, None], id_type),
                    "places": pa.array([*places, None], pa.binary()),
                    "segments": pa.array([None] * n + [list(known)], pa.list_(pa.string())),
                }
            )

        for b in batches:
            id_type = b.schema.types[0]
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if not text:
                    ids.append(i)
                    places.append(None)
                    continue
                if there and there + len(text) > size:
                    yield done()
                    ids, places, known, there, block = [], [], Numbers(), 0, block + 1
                    if not block % (1 << PER_TASK):
                        raise ValueError("a task has too many blocks: make them larger")
                parts = cut.split(text) if kept.search(text) else text.split(" ")
                ids.append(i)
                places.append(packed(np.fromiter(map(known.__getitem__, parts), np.int32, len(parts))))
                there += len(text)
        if ids:
            yield done()

    return run


def groups_of(a: list[list[int]], b: list[list[int]], a_size: np.ndarray, b_size: np.ndarray) -> list[str]:
    """For each segment the text of its groups, cut where tokens of both sides end; both sides spell the same bytes."""
    if not a:
        return []
    flat = [np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (a, b)]
    ends = [np.cumsum(size[x]) for x, size in zip(flat, (a_size, b_size), strict=True)]
    common = np.intersect1d(*ends, assume_unique=True)  # tokens have bytes, so ends ascend
    group = [np.searchsorted(common, e) for e in ends]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    ids, of = np.concatenate(flat)[order], np.concatenate(group)[order]
    second = order >= len(flat[0])
    last = np.cumsum([*map(len, a)]) - 1  # A's last token of each segment
    closing = np.zeros(len(common), bool)
    closing[group[0][last]] = True
    # what stands behind an id: a comma within a side, a bar between them, a semicolon behind a group, a line's end behind a segment
    code = np.zeros(len(ids), np.int64)
    turns = np.append(of[1:] != of[:-1], True)
    code[:-1][second[1:] > second[:-1]] = 1
    code[turns] = 2
    code[turns & closing[of]] = 3
    text: list[str] = [""] * (2 * len(ids))
    text[0::2] = map(str, ids.tolist())
    text[1::2] = map(",|;\n".__getitem__, code.tolist())
    return "".join(text).split("\n")[:-1]


def _align(open_vocabularies):
    """Rows (at, segment), in order of segments, as (at, groups): a run of equal segments is encoded once; groups are text, empty where the tokens do not spell the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc: Encoders = open_vocabularies()
        a_bytes, b_bytes = enc.a_bytes, enc.b_bytes
        a_size, b_size = (np.array([*map(len, x)], np.int64) for x in (a_bytes, b_bytes))
        spelt = lambda table, ids: b"".join([table[i] for i in ids])
        last: tuple[str | None, str] = (None, "")
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                part = big.slice(at, BATCH)
                runs = part.column(1).dictionary_encode()
                names = runs.dictionary.to_pylist()
                known = names[:1] == [last[0]]  # a run goes on from the rows before
                new = names[known:]
                a, b = enc.ids(new)
                want = [b" " + s.encode() for s in new]
                groups = [""] * len(new)
                good = [k for k, w in enumerate(want) if spelt(a_bytes, a[k]) == w and spelt(b_bytes, b[k]) == w]
                for k, g in zip(good, groups_of([a[k] for k in good], [b[k] for k in good], a_size, b_size), strict=True):
                    groups[k] = g
                groups = [last[1], *groups] if known else groups
                last = (names[-1], groups[-1])
                yield pa.record_batch({"at": part.column(0), "groups": pa.array(groups, pa.string()).take(runs.indices)})

    return run


class Parsed(NamedTuple):
    """The groups of segments as numbers: of each segment its sums, and its links as pairs (A id << 32 | B id) with how often."""

    sums: dict[str, np.ndarray]
    pairs: np.ndarray
    times: np.ndarray
    of: np.ndarray  # the segment of each pair, ascending


SUMS = ("n_a", "n_b", "n_groups", "n_links")
#: Links of a group that are written out one by one; those of longer groups are counted by id.
WIDE = 4096


def parsed(groups: pa.Array, slice_rows: int = 1 << 14) -> Parsed:
    """Reads texts of groups, slice by slice, so that the wide arrays in between stay small; an empty text has none."""
    parts = [_parsed(groups.slice(at, slice_rows)) for at in range(0, max(1, len(groups)), slice_rows)]
    sums = {k: np.concatenate([p.sums[k] for p in parts]) for k in SUMS}
    of = np.concatenate([p.of + np.int32(k * slice_rows) for k, p in enumerate(parts)])
    return Parsed(sums, np.concatenate([p.pairs for p in parts]), np.concatenate([p.times for p in parts]), of)


def _parsed(groups: pa.Array) -> Parsed:
    n = len(groups)
    some = np.flatnonzero(pc.binary_length(groups).to_numpy(zero_copy_only=False))
    text = "".join([f"{g}\n" for g in groups.filter(pc.greater(pc.binary_length(groups), 0)).to_pylist()]).encode()
    raw = np.frombuffer(text, np.uint8)
    marks = raw[(raw < 48) | (raw > 57)]  # the character behind each number
    ids = np.fromstring(text.translate(bytes.maketrans(b",|;\n", b"    ")).decode(), np.int64, sep=" ")
    bar, last, line = marks == ord("|"), (marks == ord(";")) | (marks == ord("\n")), marks == ord("\n")
    group, bars = np.cumsum(last) - last, np.cumsum(bar) - bar
    second = bars > group
    many = int(last.sum())
    size_a, size_b = np.bincount(group[~second], minlength=many), np.bincount(group[second], minlength=many)
    segment = some[(np.cumsum(line) - line)[last]] if len(some) else np.zeros(0, np.int64)  # of each group
    a, b, links = ids[~second], ids[second], size_a * size_b
    sums = {k: np.bincount(segment, v, n).astype(np.int64) for k, v in zip(SUMS, (size_a, size_b, np.ones(many), links), strict=True)}
    start_a, start_b, narrow = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b, np.flatnonzero(links <= WIDE)
    each = np.repeat(narrow, links[narrow])
    step = np.arange(len(each)) - np.repeat(np.cumsum(links[narrow]) - links[narrow], links[narrow])
    pairs = [a[start_a[each] + step // size_b[each]] << 32 | b[start_b[each] + step % size_b[each]]]
    times, of = [np.ones(len(each), np.int64)], [segment[each]]
    for g in np.flatnonzero(links > WIDE):
        (x, c), (y, d) = (np.unique(v[s[g] : s[g] + z[g]], return_counts=True) for v, s, z in ((a, start_a, size_a), (b, start_b, size_b)))
        pairs.append((x[:, None] << 32 | y[None, :]).ravel())
        times.append((c[:, None] * d[None, :]).ravel())
        of.append(np.full(len(x) * len(y), segment[g]))
    pairs, times, of = (np.concatenate(v) for v in (pairs, times, of))
    order = np.argsort(of, kind="stable")
    return Parsed(sums, pairs[order], times[order], of[order].astype(np.int32))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("at").combine_chunks()


def _composed(texts: pa.Table, segments: pa.Table) -> pa.Table:
    """A block's texts with their sums and digests, and a row of its pairs: in how many texts they are, and which segments have them."""
    groups = _sorted(segments).column("groups")
    groups = groups.combine_chunks() if isinstance(groups, pa.ChunkedArray) else groups
    groups = pa.concat_arrays([*groups.chunks, pa.array([""], pa.string())]) if isinstance(groups, pa.ChunkedArray) else pa.concat_arrays([groups, pa.array([""], pa.string())])
    found = parsed(groups)
    names, ok = np.array(groups.to_pylist(), object), pc.binary_length(groups).to_numpy(zero_copy_only=False) > 0
    sums = np.stack([found.sums[s] for s in SUMS], axis=1)
    pairs = np.unique(found.pairs)
    local = np.searchsorted(pairs, found.pairs).astype(np.int32)
    begin = np.searchsorted(found.of, np.arange(len(groups) + 1))
    holding, rows, kept = np.zeros(len(pairs), np.int64), [], []
    for place in texts.column("places"):
        own = unpacked(place.as_py()) if place.is_valid else np.zeros(0, np.int32)
        different = np.sort(own)
        different = different[np.append(different[1:] != different[:-1], True)] if len(own) else own
        if not len(own) or not ok[different].all():
            rows.append((0, 0, 0, 0, ""))
            kept.append(None)
            continue
        rows.append((*sums[own].sum(axis=0).tolist(), hashlib.sha256(";".join(names[own].tolist()).encode()).hexdigest()))
        kept.append(place.as_py())
        sizes = begin[different + 1] - begin[different]
        inside = np.arange(sizes.sum()) + np.repeat(begin[different] - np.cumsum(sizes) + sizes, sizes)
        some = np.sort(local[inside])
        holding[some[np.append(some[1:] != some[:-1], True)]] += 1
    n, held = len(rows), np.flatnonzero(holding)
    renumbered = np.cumsum(holding > 0) - 1
    used = holding[local] > 0  # pairs of no text's count for nothing
    columns = [*zip(*rows, strict=True)]
    out = {"block": pa.array([texts.column("block")[0].as_py()] * (n + 1), pa.int64())}
    out["id"] = pa.array([*texts.column("id").to_pylist(), None], texts.schema.field("id").type)
    out["places"] = pa.array([*kept, None], pa.binary())
    out |= {s: pa.array([*columns[k], 0], pa.int64()) for k, s in enumerate(SUMS)}
    out["groups_sha256"] = pa.array([*columns[len(SUMS)], ""], pa.string())
    for name, values in (("pairs", pairs[held]), ("texts", holding[held])):
        out[name] = pa.array([None] * n + [values], pa.list_(pa.int64()))
    for name, values in (("of", np.bincount(found.of[used], minlength=len(groups))), ("pair", renumbered[local[used]])):  # how many pairs each segment has, and which
        out[name] = pa.array([None] * n + [packed(values)], pa.binary())
    out["times"] = pa.array([None] * n + [found.times[used]], pa.list_(pa.int64()))
    return pa.table(out)


def _summed(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's texts with their sums over links; the block's own row has the links of its segments."""
    counts = _sorted(counts)
    whole = texts.filter(texts.column("of").is_valid()).to_pylist()[0]
    texts = texts.filter(texts.column("of").is_null())
    many, pair, times = unpacked(whole["of"]), unpacked(whole["pair"]), np.array(whole["times"], np.int64)
    of = np.repeat(np.arange(len(many)), many)
    per = {name: np.zeros(len(many), np.int64) for name in ("n_best", "count_sum")}
    for name, column in (("n_best", "best"), ("count_sum", "n")):
        np.add.at(per[name], of, times * counts.column(column).to_numpy()[pair])
    out = {k: texts.column(k) for k in ("id", *SUMS, "groups_sha256")}
    places = [unpacked(p.as_py()) if p.is_valid else np.zeros(0, np.int32) for p in texts.column("places")]
    return pa.table(out | {name: pa.array([int(v[p].sum()) for p in places], pa.int64()) for name, v in per.items()})


def align(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabularies: Vocabularies | None = None, block_chars: int = BLOCK) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    vocabularies = vocabularies or Vocabularies.read()
    shared = spark.sparkContext.broadcast(tuple(vocabularies))  # the two files, some megabytes
    work = Workspace(spark, "alignment")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    blocks = work.put(rows.mapInArrow(_blocks(cut_pattern(vocabularies), block_chars), f"block long, id {id_type}, places binary, segments array<string>"), "blocks")
    texts = work.put(blocks.where("segments is null").select("block", "id", "places"), "texts")
    # a block and a place in it are one number
    uses = blocks.where("segments is not null").select("block", F.posexplode("segments").alias("no", "segment")).select((F.shiftleft("block", 32) + F.col("no")).alias("at"), "segment")
    # equal segments of all blocks stand one after another in one task; a block has each once, so none is long
    back = work.put(uses.repartition("segment").sortWithinPartitions("segment").mapInArrow(_align(lambda: Vocabularies(*shared.value).open()), "at long, groups string"), "aligned")
    work.sweep()
    block_of = F.shiftright("at", 32)
    work.remove(blocks)
    out = f"block long, id {id_type}, places binary, {', '.join(f'{s} long' for s in SUMS)}, groups_sha256 string, pairs array<long>, texts array<long>, of binary, pair binary, times array<long>"
    composed = work.put(texts.groupBy("block").cogroup(back.groupBy(block_of.alias("b"))).applyInArrow(_composed, out), "composed")
    work.remove(texts)
    work.remove(back)
    work.sweep()
    held = composed.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "texts")).alias("no", "p"))
    held = held.select((F.shiftleft("block", 32) + F.col("no")).alias("at"), F.col("p.pairs").alias("pair"), F.col("p.texts").alias("texts"))
    counts = work.put(held.groupBy("pair").agg(F.sum("texts").alias("n")), "pairs")
    first = F.shiftrightunsigned("pair", 32)
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.withColumn("a", first).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    scored = held.join(ranked.hint("merge"), "pair").select("at", "n", "best")
    own = composed.drop("pairs", "texts")
    done = own.groupBy("block").cogroup(scored.groupBy(block_of.alias("b"))).applyInArrow(_summed, f"id {id_type}, {', '.join(f'{s} long' for s in SUMS)}, groups_sha256 string, n_best long, count_sum long")
    return done.select(F.col("id").alias(id_col), *SUMS, "n_best", "count_sum", "groups_sha256")
