"""Centroid clustering against whole-distance Lloyd rounds in plain Python."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import clusters


def lloyd(rows, k, rounds, dims, scale=256):
    """Rows (id, vector) that are kept, in order, with (id, cluster, distance, centroid digest); every distance in full."""
    good = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) and abs(v) * scale < clusters.LIMIT for v in x)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in good if i is not None)
    centers = [x for _, x in named[:k]]
    if not centers:
        return []
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = {}
        for _, x in good:
            own.setdefault(near(x)[1], []).append(x)
        centers = [[sum(v) // len(own[n]) for v in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centers)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, near(x)[1], near(x)[0], digest[near(x)[1]]) for i, x in good]


@given(st.integers(0, 2**31), st.integers(1, 70), st.integers(1, 9), st.integers(1, 20), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_partial_distances_find_the_nearest_and_its_ties(seed, n, k, dims, spread):
    rnd = np.random.default_rng(seed)  # few values, so that distances tie
    x, centers = rnd.integers(-spread, spread + 1, (n, dims)), rnd.integers(-spread, spread + 1, (k, dims))
    full = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    got, distance = clusters.nearest(x, centers, rnd.permutation(dims))
    assert (got == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_largest_components_do_not_overflow():
    far = clusters.LIMIT - 1
    x = np.full((1, 64), far)
    assert clusters.nearest(x, -x, np.arange(64))[1].tolist() == [64 * (2 * far) ** 2]


def test_rounds_equal_whole_distances_with_odd_rows(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rnd.normal(size=4) * (1 + i % 3)]) for i in range(80)]
    rows += [(200 + i, [0.5, 0.5, -0.25, 1.0]) for i in range(40)]  # a third are copies
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, [9.0, 9.0, 9.0, 9.0]), (300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 3.0, 4.0]), (304, [1.0, float("nan"), 3.0, 4.0]), (305, [float("inf"), 0.0, 0.0, 0.0]), (306, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, x string")
    got = clusters.cluster(spark, df, k=7, rounds=3, dims=4).collect()
    want = lloyd(rows, 7, 3, 4)
    assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.inertia == sum(w[2] for w in want)
        assert hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest() == r.centroid_sha256


def test_few_or_no_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    assert clusters.cluster(spark, spark.createDataFrame([], shape)).collect() == []
    assert clusters.cluster(spark, spark.createDataFrame([(1, [1.0]), (None, [0.0] * 64)], shape)).collect() == []
    got = clusters.cluster(spark, spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64)], shape)).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in got) == [(1, 0, 0), (2, 0, 0)] and len({r.cluster for r in got}) == 2
