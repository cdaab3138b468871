"""Chunks by pointers against filling them row by row."""

import random

import pytest

from tessera.operators import candidates


def filled(sizes, most, overlap):
    """Chunks as lists of row numbers, filled one row at a time."""
    done, now, total = [], [], 0
    for k, size in enumerate(sizes):
        if now and total + size > most:
            done.append(now)
            now = now[-overlap:] if overlap else []
            total = sum(sizes[i] for i in now)
        now = [*now, k]
        total += size
    return [*done, now]


@pytest.mark.parametrize("overlap", [0, 1, 3])
@pytest.mark.parametrize("block", [4096, 5])
def test_chunks_equal_filling_row_by_row(spark, monkeypatch, overlap, block):
    monkeypatch.setattr(candidates, "SUMS_BLOCK", block)
    rnd = random.Random(overlap)
    docs = {d: [rnd.choice([1, 40, 300, 999, 1000, 1001, 2500]) if d % 2 else rnd.randrange(1, 120) for _ in range(rnd.choice([1, 2, 3, 30, 90]))] for d in range(12)}
    rows = spark.createDataFrame([(d, k, s) for d, sizes in docs.items() for k, s in enumerate(sizes)], "doc_id long, seq long, size long")
    got = sorted(map(tuple, candidates.chunks(rows, 1000, overlap).collect()))
    assert got == sorted((d, c, k) for d, sizes in docs.items() for c, chunk in enumerate(filled(sizes, 1000, overlap), 1) for k in chunk)


def test_no_rows_give_no_chunks(spark):
    assert candidates.chunks(spark.createDataFrame([], "doc_id long, seq long, size long"), 1000, 2).collect() == []
