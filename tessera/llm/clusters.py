"""Centroid clustering of integer vectors by partial-distance search.

Vectors become integers, floor(scale * x), so that distances, sums and ties are exact on any machine and in any
order of rows.  Squared differences are summed over the dimensions of highest variance first.  Before
each further block of dimensions a centroid is abandoned for a vector if its sum so far lies strictly above the best
full distance known for that vector, so a centroid that ties is never abandoned; survivors finish all dimensions.
The order of dimensions changes the work and nothing else.

The first centroids are the k vectors whose ids hash least.  A round assigns every vector to its nearest centroid
(ties: the smaller number) and replaces each centroid that has vectors by the floor of their mean.  k * dims
numbers travel to the driver in a round, as map-side sums of each task; vectors stay where they are.

Kept are vectors with `dims` components, none null or non-finite.  A component of 2**26 or more in size after
scaling has squared distances that no long holds, so such a vector is not kept either.  Fewer than k vectors make as
many clusters as there are.  Rows that repeat an id, or a whole row, are vectors of their own and may start clusters of
their own (ties of the hash: by components).  A null id is an id like others, but starts no cluster.  Inertia beyond a
long is null.  An empty table, or one without a kept vector, gives an empty result; columns besides the two are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Size of a scaled component that a squared distance over 2**9 dimensions still holds; dimensions between two prunings; vectors compared at once.
LIMIT, STEP, ROWS = 1 << 26, 8, 2048


def kept(vector: Column, dims: int, scale: int) -> Column:
    """Whether a vector takes part."""
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LIMIT)
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, fits), F.lit(False))


def nearest(x: np.ndarray, centers: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest center, ties to the smaller number; integers throughout.

    The first best is the full distance to the center that leads on the first dimensions.
    """
    x, centers = x[:, order], centers[:, order]
    n, dims = x.shape
    at = min(STEP, dims)
    sums = np.zeros((n, len(centers)), np.int64)
    for d in range(at):
        sums += (x[:, d, None] - centers[None, :, d]) ** 2
    best = ((x - centers[sums.argmin(axis=1)]) ** 2).sum(axis=1)
    i, c = np.nonzero(sums <= best[:, None])
    sums = sums[i, c]
    while at < dims and len(i):
        to = min(dims, at + STEP)
        sums = sums + ((x[i, at:to] - centers[c, at:to]) ** 2).sum(axis=1)
        keep = sums <= best[i]
        i, c, sums, at = i[keep], c[keep], sums[keep], to
    # survivors are ordered by row, then center, and hold every center at the least distance
    np.minimum.at(best, i, sums)
    least = sums == best[i]
    first = np.full(n, len(centers))
    np.minimum.at(first, i[least], c[least])
    return first, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _spread(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            x = _matrix(b.column(0), dims).astype(np.float64)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
        yield pa.record_batch({"d": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "one": one, "two": two})

    return run


def _assigned(centers: np.ndarray, order: np.ndarray, dims: int, totals: bool):
    """Rows with their cluster and distance, or with totals a row of sums for each cluster of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centers), np.int64), np.zeros((len(centers), dims), np.int64)
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                x = _matrix(b.column(1), dims)
                cluster, distance = nearest(x, centers, order)
                if totals:
                    count += np.bincount(cluster, minlength=len(centers))
                    np.add.at(sums, cluster, x)
                else:
                    yield pa.record_batch({"id": b.column(0), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())})
        if totals:
            some = np.flatnonzero(count)
            yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "n": count[some], **{f"s{d}": sums[some, d] for d in range(dims)}})

    return run


def cluster(
    spark: SparkSession, rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2"
) -> DataFrame:
    """One row per kept vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    k and dims are taken to be small: k * dims numbers are held on the driver.
    """
    work = Workspace(spark, "clusters")
    wide = F.col(vector_col).cast("array<double>")
    good = rows.select(F.col(id_col).cast("long").alias("id"), wide.alias("v")).where(kept(F.col("v"), dims, scale))
    # written once: every round reads integers, and the source's plan is not run again
    x = work.put(good.select("id", F.transform("v", lambda v: F.floor(v * scale).cast("int")).alias("x")), "integers")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    starts = x.where("id is not null").orderBy(name, "x").limit(k).collect()  # k rows
    out = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<bigint>"
    if not starts:
        return spark.createDataFrame([], out)
    centers = np.array([r.x for r in starts], np.int64)
    spread = x.select("x").mapInArrow(_spread(dims), "d int, n long, one double, two double").groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")]).toPandas().sort_values("d")
    order = np.argsort(-(spread.two / spread.n - (spread.one / spread.n) ** 2).to_numpy(), kind="stable")
    sums = [f"s{d}" for d in range(dims)]
    for _ in range(rounds):
        part = x.mapInArrow(_assigned(centers, order, dims, True), "cluster int, n long, " + ", ".join(f"{s} long" for s in sums))
        centers = centers.copy()
        for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():
            centers[r.cluster] = [r[s] // r.n for s in sums]
    done = work.put(x.mapInArrow(_assigned(centers, order, dims, False), "id long, cluster int, distance long"), "assigned")
    totals = {r.cluster: int(r.d) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    long = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    table = spark.createDataFrame([(c, totals[c] if totals[c] < 1 << 63 else None, digest[c], centers[c].tolist()) for c in sorted(totals)], "cluster int, cluster_inertia long, centroid_sha256 string, centroid array<bigint>")
    # k rows at most
    named = done.join(F.broadcast(table), "cluster")
    return named.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", long(sum(totals.values())).alias("inertia"), "centroid_sha256", "centroid")


def oracle_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> str:
    """The same columns but the centroid in DuckDB SQL, every distance in full."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = lambda t: f"select v.r, arg_min(c.no, {{'d': {far}, 'no': c.no}}) no, min({far}) d from v, {t} c group by v.r"
    # floor of the exact quotient: // cuts towards zero
    mean = ", ".join(f"cast((sum(x[{d}]) // count(*)) - case when sum(x[{d}]) % count(*) < 0 then 1 else 0 end as bigint)" for d in range(1, dims + 1))
    steps = ""
    for n in range(rounds):
        steps += f"""
a{n} as materialized ({near(f"c{n}")}),
c{n + 1} as materialized (select c.no, coalesce(m.x, c.x) x from c{n} c left join (select no, [{mean}] x from a{n} join v using (r) group by no) m using (no)),"""
    return f"""
with v as materialized (
  select row_number() over () r, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) x from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e) and abs(cast(e as double)) * {scale} < {LIMIT})) = {dims}),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), x) - 1 no, x from v where vec_id is not null qualify no < {k}),{steps}
f as materialized ({near(f"c{rounds}")}),
t as (select no, cast(sum(d) as bigint) own from f group by no)
select v.vec_id, cast(f.no as int) as cluster, cast(f.d as bigint) distance, t.own cluster_inertia, cast((select sum(own) from t) as bigint) inertia,
       sha256(array_to_string(c.x, ',')) centroid_sha256
from f join v using (r) join t using (no) join c{rounds} c using (no)
"""
