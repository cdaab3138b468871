"""MinHash, suffix-array, line and embedding dedup against brute force, with the odd cases each must take."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import embeddings, lines, minhash, queries, suffix

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"w{i}" for i in range(400))


def closed(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def near_texts():
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghij") + str(rnd.randrange(50)) for _ in range(150)]
    rows = [(1, LONG), (2, LONG.upper()), (3, LONG + " tail"), (4, None), (5, ""), (6, "one two"), (7, "One  two"), (8, "one two"), (9, " \t\n"), (10, "éà " * 9)]
    for k in range(60):  # a crowd whose members mostly are too far apart to link, around a base
        words = list(base)
        for _ in range(k % 5):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((100 + k, " ".join(words)))
    return [*rows, (1, LONG)]


@pytest.mark.parametrize(("small", "crowd"), [(12, 64), (2, 3)])
def test_minhash_links_are_exact(spark, monkeypatch, small, crowd):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rows = near_texts()
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closed(ids, links)
    docs = spark.createDataFrame([(i, t, "extra", None) for i, t in rows], "doc_id long, text string, id string, n int")
    got = minhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), want[i], want[i] == i) for i in ids}


def test_minhash_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    crowd = [r for r in near_texts() if r[0] >= 100]
    lone = " ".join(f"lone{k}" for k in range(90))
    rows = [*crowd, *crowd, (130, lone), (100, LONG), (7, LONG + " tail")]  # 130 and 100 have two texts each
    nodes = sorted({(i, t) for i, t in rows})
    sets = {node: shingle_set(node[1]) for node in nodes}
    near = [(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = closed({i for i, _ in nodes}, [(a[0], b[0]) for a, b in near])
    got = minhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i, t]), want[i], want[i] == i) for i, t in nodes}
    monkeypatch.undo()
    some = [(130, lone), (130, crowd[0][1]), (100, crowd[0][1]), (100, crowd[0][1]), (140, LONG), (140, LONG + " tail"), (None, lone)]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept) == sorted([(0, lone[:5]), (130, lone[:5]), (100, crowd[0][1][:5]), (140, LONG[:5])])


def test_pipeline_takes_near_duplicates_from_080(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS)
    words = [f"v{k}" for k in range(204)]
    made = [(20_000 + k, " ".join(words[: 204 - k])) for k in (0, 33, 41)]  # 200, 167 and 159 shingles: 0.835, 0.795 and 0.952
    made += [(30_000, " ".join(f"u{k}" for k in range(204))), (30_001, " ".join(f"u{k}" for k in range(164))), (30_002, " ".join(f"z{k}" for k in range(204))), (30_003, " ".join(f"z{k}" for k in range(163)))]  # 0.80 and 0.795
    docs = table.union(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], table.schema))
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(ids, links)
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == [i for i in ids if want[i] == i]
    assert {i for i in kept if i >= 20_000} == {20_000, 30_000, 30_002, 30_003}


def test_minhash_of_an_empty_table(spark):
    assert minhash.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_tensored_sketches_need_few_minhashes():
    sets = minhash.shingles(np.frombuffer(LONG.encode(), np.uint8), np.array([0, len(LONG)]), 5)
    assert minhash.sketches(sets, 8, 2, 1).shape == (1, 16)


def repeat_texts():
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage, other = text(90), text(70)
    return [
        (1, text(50) + passage + text(30)), (2, passage + text(60)), (3, text(80)), (4, None), (5, ""), (6, "a" * 120), (7, "ab" * 60), (8, text(20) + other + text(9) + other), (9, text(300)),
        (10, passage + other), (11, "c" * 41), (12, "d" * 40),
    ]


def covered(texts, owners, length, earlier=False, other=False):
    """For each text a mark for each byte within a string of `length` that starts elsewhere too (earlier: before; other: in another document)."""
    seen = {}
    for k, x in enumerate(texts):
        for i in range(len(x) - length + 1):
            seen.setdefault(x[i : i + length], []).append((k, i))
    gone = [bytearray(len(x)) for x in texts]
    for places in seen.values():
        for k, i in places:
            if places[0] < (k, i) if earlier else len({owners[j] for j, _ in places}) > 1 if other else len(places) > 1:
                gone[k][i : i + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("group", [2000, 1])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup_is_exact(spark, monkeypatch, keep, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = repeat_texts()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("doc_id", "k1")
    docs = docs.selectExpr("k1", "hash(text) + 0L as k2", "text")
    found = suffix.repeated_intervals(spark, docs, length=40, gram=12, keep=keep)
    gone, other = ({i: bytearray(len((t or "").encode())) for i, t in rows} for _ in range(2))
    for r in found.collect():
        for marks in (gone, *([other] if r.other else [])):
            marks[r.k1][r.s : r.e] = b"\1" * (r.e - r.s)
    texts, ids = [(t or "").encode() for _, t in rows], [i for i, _ in rows]
    assert list(gone.values()) == covered(texts, ids, 40, earlier=keep == "first")
    if keep == "none":
        assert list(other.values()) == covered(texts, ids, 40, other=True)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_removal_of_repeats_is_exact(spark, keep):
    rows = [*repeat_texts(), (13, "é" * 33), (14, "éé" * 25 + "tail")]
    texts = [(t or "").encode() for _, t in rows]
    got = {r.doc_id: r for r in suffix.kept_digest(suffix.remove_repeats(spark, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int"), length=60, passage=40, keep=keep)).collect()}
    want = suffix.brute_force(texts, 60, earlier=keep == "first")
    shared = covered(texts, [i for i, _ in rows], 40, other=True)
    for (i, _), t, (removed, runs, sha), marks in zip(rows, texts, want, shared, strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), removed, runs, sha)
        if keep == "none":
            assert (r.n_shared, r.shared) == (sum(marks), any(marks))


def test_suffix_dedup_tells_thue_morse_words_apart(spark):
    word = [0]
    while len(word) < 4096:
        word += [1 - v for v in word]
    for n in (1024, 4096):
        a, b = ("".join("xy"[v ^ flip] for v in word[:n]) for flip in (0, 1))
        got = suffix.remove_repeats(spark, spark.createDataFrame([(1, a), (2, b)], SCHEMA)).collect()
        want = suffix.brute_force([a.encode(), b.encode()], 400)
        assert sorted(r.n_removed for r in got) == sorted(w[0] for w in want)
        docs = spark.createDataFrame([(1, a), (2, b), (3, a + "\n" + b)], SCHEMA)
        assert {r.doc_id: r.n_removed for r in lines.dedup(spark, docs, least=1, emptied="gone").collect()} == {1: 0, 2: 0, 3: 2}
        assert {r.component_id for r in minhash.near_duplicates(spark, docs.where("doc_id < 3")).collect()} == {1, 2}


def test_suffix_dedup_of_copies_and_long_texts(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(700_000))
    rows = [(1, LONG), (1, LONG), (None, LONG), (2, "short"), (3, long)]
    got = suffix.kept_digest(suffix.remove_repeats(spark, spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.doc_id or 0, r.n_removed == r.n_bytes) for r in got if r.doc_id != 3) == [(0, True), (1, True), (1, True), (2, False)]
    want = suffix.brute_force([long.encode()[:3000]], 400)
    assert want[0][0] <= next(r.n_removed for r in got if r.doc_id == 3)
    assert suffix.remove_repeats(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_matches_are_the_neighbours_of_a_suffix():
    text = np.frombuffer(b"abcxabcyabc" + bytes(3), np.uint8)
    earlier, later, other = suffix.matches(text, np.arange(11), 3, np.array([0] * 4 + [1] * 7), np.zeros(11, bool))
    assert (earlier[[0, 4, 8]].tolist(), later[[0, 4, 8]].tolist()) == ([-1, 0, 4], [4, 8, -1])
    assert other[[0, 4, 8]].all() and not other[[1, 2, 3, 5]].any()


def test_suffix_order_agrees_with_sorting():
    text = np.frombuffer(b"abracadabra-abracadabra-abrac" + bytes(12), np.uint8)
    starts = np.arange(len(text) - 12)
    order, new = suffix.suffix_order(text, starts, 11)
    keys = [bytes(text[i : i + 11]) for i in starts]
    assert [keys[i] for i in order] == sorted(keys)
    assert new.sum() == len(set(keys))


def line_texts():
    rnd = random.Random(7)
    line = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n)).strip().ljust(n, "z")
    rows = []
    for n in (*range(22, 40), 64, 65, 120, 300):
        x = line(n)
        p = rnd.randrange(n)
        near = [x[:p] + "#" + x[p:], x[:p] + x[p + 1 :], x[:p] + "#" + x[p + 1 :], "#" + x, x + "#", x[1:], x[:-1], x[:p] + "##" + x[p:]]
        rows.append((len(rows), "\n".join([x, "tiny", *near])))
        rows.append((len(rows), f"  {x}  \n" + line(50)))
    return [*rows, (900, None), (901, ""), (902, "\n\n"), (903, rows[1][1]), (903, rows[1][1]), (904, "y" * 50), (905, "y" * 51)]


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k:] == b[k:] or a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def test_line_dedup_is_exact(spark):
    rows = line_texts()
    first = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            x = x.strip(" \t\r\x0b\x0c")
            if len(x) >= lines.LEAST:
                first.setdefault(x, (i, n))
    goes = {x: any(f < first[x] and within_one(x, y) for y, f in first.items()) for x in first}
    want = {}
    for i, t in rows:
        kept = []
        for n, x in enumerate((t or "").split("\n")):
            s = x.strip(" \t\r\x0b\x0c")
            if len(s) < lines.LEAST or not (goes[s] or first[s] < (i, n)):
                kept.append(x)
        if len(kept) == len((t or "").split("\n")) or any(len(x.strip(" \t\r\x0b\x0c")) >= lines.LEAST for x in kept):
            want[i] = "\n".join(kept)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, _id string, n_removed string")
    got = lines.dedup(spark, docs)
    assert got.columns == ["doc_id", "text", "n", "_id", "n_removed"]
    assert {r.doc_id: r.text or "" for r in got.collect()} == want


def test_line_dedup_of_equal_lines_only(spark):
    x, y = "a line of more than twenty characters", "a line of more than twenty charakters"
    docs = spark.createDataFrame([(1, x), (2, y), (3, x + "\nkept"), (4, x + "\n" + x[::-1])], SCHEMA)
    assert {r.doc_id: r.text for r in lines.dedup(spark, docs, edits=0).collect()} == {1: x, 2: y, 4: x[::-1]}
    assert lines.dedup(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="edits"):
        lines.dedup(spark, docs, edits=2)


def test_line_dedup_takes_short_lines(spark):
    rnd = random.Random(11)
    rows = [(1, "menu\nAll rights reserved.\nown one"), (2, "menu\n  All rights reserved.\n}\n\nown two"), (3, "page 1\n}\nmenu\n\nown three"), (4, "page 2\n\nmenu")]
    for n in range(10, 30):  # near copies of short lines, from 12 characters on
        x = "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
        for k, y in enumerate((x, x[: n // 2] + "#" + x[n // 2 :], x[: n // 3] + "#" + x[n // 3 + 1 :], x[:-1], "#" + x, x[1:])):
            rows.append((100 + 10 * n + k, y + f"\n{'.' * (n * 10 + k) * 2}"[: 2 + n]))
    first, want = {}, {}
    for i, t in rows:
        for n, x in enumerate(t.split("\n")):
            if x.strip():
                first.setdefault(x.strip(), (i, n))
    goes = {x: any(f < first[x] and min(len(x), len(y)) >= 12 and within_one(x, y) for y, f in first.items()) for x in first}
    for i, t in rows:
        want[i] = [x for n, x in enumerate(t.split("\n")) if not x.strip() or not (goes[x.strip()] or first[x.strip()] < (i, n))]
    got = lines.dedup(spark, spark.createDataFrame(rows, SCHEMA), least=1).collect()
    assert {r.doc_id: r.text for r in got} == {i: "\n".join(kept) for i, kept in want.items() if any(x.strip() for x in kept)}
    assert {r.doc_id: r.text for r in got if r.doc_id < 5} == {1: rows[0][1], 2: "}\n\nown two", 3: "page 1\n\nown three", 4: "page 2\n"}


def test_line_dedup_keeps_documents_of_short_lines(spark, tmp_path):
    shared = "a license line that many documents share"
    rows = [(1, shared), (2, shared + "\n" + "\n".join(f"verse {k * k * 997}" for k in range(200))), (3, f"{shared}\n \n"), (4, shared), (5, None), (6, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert {i: (r.n_removed, r.emptied) for i, r in got.items()} == {1: (0, False), 2: (1, False), 3: (1, True), 4: (1, True), 5: (0, False), 6: (0, False)}
    assert got[2].kept_sha256 == hashlib.sha256(rows[1][1].split("\n", 1)[1].encode()).hexdigest()
    assert got[3].n_bytes == got[4].n_bytes == 0
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == {1, 2, 5, 6}


def test_embedding_links_are_exact(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(12, 24))
    rows = []
    for k in range(160):
        v = (base[k % 12] + rnd.normal(size=24) * (0.02 + 0.012 * (k % 11))).astype(np.float32)
        rows.append((k, [float(x) for x in v], k % 3 if k % 10 else 0))
    rows += [(200, None, 1), (201, [0.0] * 24, 1), (202, [float("nan")] * 24, 1), (203, [1.0] * 23 + [None], 1), (204, rows[0][1], None), (205, [], 1), (206, rows[0][1], 0), (207, [2 * x for x in rows[0][1]], 0), (208, [1.0, 2.0], 0), (206, rows[0][1], 0)]
    usable = [(n, i, np.array(v, float) / np.linalg.norm(v), lab) for n, (i, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a in usable for b in usable if a[0] < b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and float(a[2] @ b[2]) >= 0.98]
    want = closed([i for i, _, _ in rows], [(a[1], b[1]) for a, b in links])
    n = {k: sum(k in (a[0], b[0]) for a, b in links) for k in range(len(rows))}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark, docs).collect())
    assert got == sorted((i, n[k], want[i], want[i] == i) for k, (i, _, _) in enumerate(rows))
    assert embeddings.near_duplicates(spark, docs.limit(0)).collect() == []


def test_embeddings_of_extreme_size_and_repeated_ids(spark):
    rows = [(1, [1e-170, 2e-170]), (2, [1.0, 2.0]), (3, [1e200, 0.0]), (4, [1e200, 1.0]), (None, [1.0, 2.0]), (5, [0.0, 1.0]), (6, [0.0, 1.0]), (6, [-1.0, 0.0]), (7, [-1.0, 0.0]), (7, None)]
    got = embeddings.near_duplicates(spark, spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == sorted([(1, 2, 1, True), (2, 2, 1, False), (0, 2, 1, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False), (6, 1, 5, False), (7, 1, 5, False), (7, 0, 5, False)])
