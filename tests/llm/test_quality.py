"""Quality rules against counts by definition, exact fractions, and simulated strata."""

import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@given(st.text(alphabet="aB b\n\t#|é\x1c ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts(text):
    assert quality.counts(text)[:5] == brute(text)


@pytest.mark.parametrize("width", [2, 3, 5])
def test_repeated_words_of_long_texts(width):
    rnd = random.Random(width)
    words = [f"w{rnd.randrange(9)}" for _ in range(400)] + [f"u{i}" for i in range(30_000)]
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    assert quality.repeated_words(words, width) == len({i + o for i, w in enumerate(windows) if seen[w] > 1 for o in range(width)})


@given(st.integers(1, 120), st.data())
@settings(max_examples=80, deadline=None)
def test_binomial_bounds_are_exact(n, data):
    k, p = data.draw(st.integers(0, n)), Fraction(data.draw(st.integers(1, 39)), 40)
    want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.at_most(k, n, float(p)) == pytest.approx(float(want), rel=1e-9)
    if k < n:
        assert quality.at_most(k, n, quality.bound(k, n, 0.05)) == pytest.approx(0.05, rel=1e-6)


def test_bounds_of_large_counts():
    assert quality.bound(0, 149, 0.05) < 0.02 < quality.bound(0, 148, 0.05)  # 1 - 0.05 ** (1 / n)
    assert 0.01 < quality.bound(1_000_000, 100_000_000, 1e-6) < 0.0101


def test_false_rejections_stay_within_the_risk(spark):
    """In few of many draws of a stratum the chosen cutoffs reject more of its good documents than they may."""
    rnd, strata, n = np.random.default_rng(5), 120, 300
    rates = rnd.gamma(2.0, 60.0, (strata, n)).astype(int)  # symbols for 1000 words, alike in all strata
    rows = [(s * n + i, f"s{s}", 1000, 5000, int(rates[s, i]), 0, 0, 10, 0, 4000) for s in range(strata) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, stratum string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    everyone = df.select("id")
    truth = np.random.default_rng(6).gamma(2.0, 60.0, 1_000_000)
    # each stratum tested as if alone, so that its own share of failures shows
    chosen = [r for s in range(0, strata, 12) for r in quality.cutoffs(df.where(F.col("stratum") == f"s{s}"), everyone).where("rule = 'symbols'").collect()]
    assert len(chosen) >= 8
    assert sum((truth > r.cutoff).mean() > 0.1 / len(quality.RULES) for r in chosen) <= 2
    together = quality.cutoffs(df, everyone).where("rule = 'symbols'").collect()
    assert not [r for r in together if (truth > r.cutoff).mean() > 0.1 / len(quality.RULES)]
    assert all(r.bound <= 0.1 / len(quality.RULES) and r.n == n for r in together)


def test_odd_rows_and_choices(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(60)), "en", 1) for i in range(200)]
    bad = [(1000 + i, " ".join(f"{j}###" for j in range(60)), "en", 0) for i in range(50)]
    other = [(2000 + i, " ".join(f"{j}###" for j in range(60)), None, 1) for i in range(20)]
    odd = [(3000, None, "en", 1), (3001, "", "en", 1), (3002, "a b c " * 40, "en", 1), (None, good[0][1], "en", 1), (5, good[5][1], "en", 1), (3003, "x" * 300_000, "en", 1)]
    rows = good + bad + other + odd
    docs = spark.createDataFrame([(i, t, s, "z") for i, t, s, _ in rows], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows] + [(7, 0, 0), (9999, 1, 0)], "doc_id long, quality int, n_words int")
    got = quality.judge(spark, docs, labels).collect()
    assert len(got) == len(rows)
    texts = {(i, t) for i, t, _, _ in rows}
    for r in got:
        assert any(i == r.doc_id and brute(t) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for i, t in texts if i == r.doc_id)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {i for i, *_ in good} | {i for i, *_ in other} | {None}  # a stratum with few labels has no cutoff
    assert {r.doc_id for r in got if r.base_failed} == {3000, 3001, 3002, 3003}
    assert {r.rejected_by for r in got if 1000 <= (r.doc_id or 0) < 1050} == {"symbols"}
    assert all(not r.rejected_by for r in quality.judge(spark, docs, labels.limit(0)).collect())
    assert quality.judge(spark, docs.limit(0), labels).collect() == []


def test_many_strata_are_joined_by_key(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60)) + " #" * (i % 7), f"l{i % 3}") for i in range(600)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("quality"))
    one = quality.judge(spark, docs, labels, least=2, risk=0.99, doubt=0.9)
    monkeypatch.setattr(quality, "FEW_STRATA", 0)
    two = quality.judge(spark, docs, labels, least=2, risk=0.99, doubt=0.9)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.where("rejected_by <> ''").count()
