"""Cross-tokenizer alignment against encoding whole texts and pairing all tokens."""

import hashlib
import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import alignment

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def enc():
    return alignment.Vocabularies.read().open()


def whole(enc, text):
    """(A ids, B ids) of a whole text, or none."""
    if not text:
        return [], []
    a, b = enc.a.encode(" " + text, add_special_tokens=False).ids, enc.b.encode(text)
    want = (" " + text).encode()
    if b"".join(enc.a_bytes[i] for i in a) != want or b"".join(enc.b_bytes[i] for i in b) != want:
        return [], []
    return a, b


def brute(enc, rows):
    """(id, sums..., digest) of rows (id, text), by byte ranges of whole texts."""
    made, per_pair, best = [], Counter(), {}
    for i, text in rows:
        a, b = whole(enc, text)
        ends = []
        for ids, size in ((a, enc.a_bytes), (b, enc.b_bytes)):
            at, e = 0, []
            for x in ids:
                at += len(size[x])
                e.append(at)
            ends.append(e)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([x for x, e in zip(a, ends[0], strict=True) if lo < e <= hi], [x for x, e in zip(b, ends[1], strict=True) if lo < e <= hi]) for lo, hi in zip([0, *common], common, strict=False)]
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        per_pair.update(set(links))
        made.append((i, len(a), len(b), groups, links))
    for (x, _), n in per_pair.items():
        best[x] = max(best.get(x, 0), n)
    for i, a, b, groups, links in made:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield i, a, b, len(groups), len(links), sum(per_pair[p] == best[p[0]] for p in links), sum(per_pair[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""


ODD = [
    None, "", " ", "  ", "   a", "a ", "a  ", "a\n b", "a \n  b\n", "don't 12 345 ... we'll", "<|endoftext|> x<s> y</s> <unk>", "a▁b", "▁", "x ▁ y", "\0a", "a  b  c    d", "a　 b", "﻿z", "é é ﬁ ½ ", "日本語 テキスト 日本語",
    "👩‍👩‍👧 🏳️‍🌈x", ");\r\n  }\r\n\r\n x", "\t\t x\t y", "a\x1c b\x85 c  d᠎ e", "​ ​", "ß" * 700, "ab" * 900, "x  " * 300, "a" + " " * 900 + "b",
]
TEXT = st.text(alphabet=" ab1.'\n\t\r;) 　é日👩▁\x1c <|>s", max_size=40)


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=200, deadline=None)
def test_segments_have_the_tokens_of_the_text(enc, texts):
    import re

    cut = re.compile(CUT)
    for text in texts:
        parts = cut.split(text)
        assert " ".join(parts) == text
        if text and whole(enc, text) != ([], []):
            a, b = enc.ids(parts)
            assert (sum(a, []), sum(b, [])) == whole(enc, text)


CUT = alignment.cut_pattern(alignment.Vocabularies.read())


def test_documents_equal_brute_force(spark, enc):
    rows = [*enumerate(ODD)] + [(100, "the same text, twice"), (101, "the same text, twice"), (101, "the same text, twice"), (101, "another text"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, places string")
    want = sorted(brute(enc, rows), key=str)
    for size in (alignment.BLOCK, 20):  # one block a partition, and one for nearly each text
        assert sorted(map(tuple, alignment.align(spark, docs, block_chars=size).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == want
    assert alignment.align(spark, docs.limit(0)).collect() == []
    assert [r.n_a for r in alignment.align(spark, docs.where("text is null or text = ''")).collect()] == [0, 0]


def test_test_table_equals_brute_force(spark, enc):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = alignment.align(spark, docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 2500]  # counts need all texts, so these links alone are compared
    mine = {r.doc_id: r for r in got}
    for i, a, b, groups, links, _, _, digest in brute(enc, rows):
        r = mine[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (a, b, groups, links, digest)
        assert r.count_sum >= links >= r.n_best


def test_vocabularies_without_proof_are_refused():
    real, spec = alignment.Vocabularies.read(), json.loads(alignment.Vocabularies.read().a)
    for changed in ({"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}, {"normalizer": {"type": "NFC"}}):
        with pytest.raises(ValueError):
            alignment.cut_pattern(real._replace(a=json.dumps(spec | changed)))


def test_groups_end_where_both_sides_end():
    sizes = [np.array(x) for x in ([1, 2, 3], [1, 2])]
    assert alignment.groups_of([[0, 0, 1], [2, 2], [0]], [[1, 1], [1, 1, 1], [0]], *sizes) == ["0,0|1;1|1", "2,2|1,1,1", "0|0"]
    assert alignment.groups_of([], [], *sizes) == []


@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 99), min_size=1, max_size=5), st.lists(st.integers(0, 9), min_size=1, max_size=5)), max_size=4), max_size=6), st.sampled_from([0, 3, alignment.WIDE]), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_groups_are_read_back(segments, wide, rows):
    before, alignment.WIDE = alignment.WIDE, wide
    try:
        got = alignment.parsed(pa.array([";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups) for groups in segments], pa.string()), rows)
    finally:
        alignment.WIDE = before
    for k, groups in enumerate(segments):
        want = Counter((x, y) for a, b in groups for x in a for y in b)
        mine = Counter()
        for p, t in zip(got.pairs[got.of == k].tolist(), got.times[got.of == k].tolist(), strict=True):
            mine[p >> 32, p & 0xFFFFFFFF] += t
        assert mine == want
        assert [int(got.sums[s][k]) for s in alignment.SUMS] == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(want.values())]
