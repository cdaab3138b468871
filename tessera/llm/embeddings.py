"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of one label are compared by cosine.  They are rotated onto principal axes of the whole table, so
that a few leading coordinates hold most of a product.  Unit vectors with cosine t are within
sqrt(2 - 2 t) of each other, on every axis, so cells of that width on the first axes confine partners to
neighbouring cells.  A cell is dealt into tiles of bounded size; for two tiles the leading products come
first, the rest is bounded by the suffix norms, and pairs that cannot reach the threshold are left out
before more axes are added.  What is left is decided on the original vectors in double precision.

Equal vectors are one class with a count.  A pair of tiles gives counts of links and a spanning star of
each linked part, not its pairs.  Null labels, null or empty vectors, and those that are zero or hold null
or non-finite components link with nothing.  Vectors are scaled by their largest component first, so that
norms neither vanish nor overflow.  Rows that repeat an id are vectors of their own, and one node.  Rows with a
null id count as links of others, are no component's smallest id, and are kept.  Vectors of different lengths are
never compared; very long ones need d * d sums each.  Cosines at the threshold link.  An empty table gives an empty
result; columns besides the three are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, components

#: Rows of a tile; axes that make cells; axes added between two prunings.
TILE, CELL_AXES, STEP = 1024, 2, 12


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for x in _unit(b.column(0)).values():
            d = x.shape[1]
            sums[d] = sums.get(d, np.zeros((d, d))) + x.T @ x
    for d, m in sums.items():
        i, j = np.triu_indices(d)
        yield pa.record_batch({"d": np.full(len(i), d), "i": i, "j": j, "v": m[i, j]})


def _unit(column: pa.Array) -> dict[int, np.ndarray]:
    """Unit rows of a list column in double precision, by length."""
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = {}
    for d in np.unique(sizes):
        x = values[(offsets[:-1][sizes == d])[:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[int(d)] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, principal axes as columns, leading first; d * d sums for each come to the driver."""
    out = {}
    sums = vectors.select("embedding").mapInArrow(_moments, "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    for d, part in sums.groupby("d"):
        m = np.zeros((d, d))
        m[part.i, part.j] = part.v
        m = m + m.T - np.diag(m.diagonal())
        out[int(d)] = np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1])
    return out


def _celled(basis: dict[int, np.ndarray], width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            cell = np.zeros((b.num_rows, CELL_AXES), np.int64)
            for d, x in _unit(b.column(1)).items():
                lead = np.floor(x @ basis[d][:, :CELL_AXES] / width).astype(np.int64)
                cell[sizes == d, : lead.shape[1]] = lead
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cell[:, k]) for k in range(CELL_AXES))], [*b.schema.names, *(f"c{k}" for k in range(CELL_AXES))])

    return run


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the unit rows of a and b with cosine >= threshold."""
    slack = threshold - 1e-9
    x, y = a @ basis, b @ basis
    d = x.shape[1]
    left_x, left_y = (np.sqrt(np.maximum(0, 1 - np.cumsum(v * v, axis=1))) for v in (x, y))
    at = min(STEP, d)
    sums = x[:, :at] @ y[:, :at].T
    i, j = np.nonzero(sums + left_x[:, at - 1][:, None] * left_y[:, at - 1][None, :] >= slack)
    sums = sums[i, j]
    while at < d and len(i):
        to = min(d, at + STEP)
        sums = sums + np.einsum("ij,ij->i", x[i, at:to], y[j, at:to])
        keep = sums + left_x[i, to - 1] * left_y[j, to - 1] >= slack
        i, j, sums, at = i[keep], j[keep], sums[keep], to
    exact = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
    return i[exact], j[exact]


def _compared(bases, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("embedding").chunk(0)
        cid, many = (table.column(k).to_numpy() for k in ("cid", "many"))
        second = table.column("second").to_numpy()
        first_side, other = np.flatnonzero(second != 1), np.flatnonzero(second != 0)
        ((d, unit),) = _unit(column).items()
        same = table.column("t1")[0].as_py() == table.column("t2")[0].as_py() and table.column("own")[0].as_py()
        other = first_side if same else other
        i, j = linked(unit[first_side], unit[other], bases()[d], threshold)
        i, j = first_side[i], other[j]
        if same:
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, many[j], len(cid)) + np.bincount(j, many[i], len(cid))
        label = cid.copy()
        while True:  # the least class reachable within this pair of tiles
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(links)
        return pa.table({"cid": cid[some], "links": links[some].astype(np.int64), "least": label[some]})

    return run


def near_duplicates(spark: SparkSession, rows: DataFrame, *, threshold: float = 0.98) -> DataFrame:
    """One row per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    work = Workspace(spark, "embeddings")
    big = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    all_rows = rows.select(F.col("vec_id").cast("long").alias("id"), "label", big.alias("embedding"))
    good = all_rows.where(usable).select("id", "label", "embedding", F.xxhash64("label", "embedding").alias("cid"))
    classes = work.put(good.groupBy("cid", "label", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("many")).select("cid", "embedding", "label", "id", "many"), "classes")
    basis = axes(classes)
    shared = spark.sparkContext.broadcast(basis)  # d * d numbers
    width = float(np.sqrt(2 - 2 * threshold) * (1 + 1e-9))
    cell = [f"c{k}" for k in range(CELL_AXES)]
    celled = work.put(classes.drop("id").mapInArrow(_celled(basis, width), f"cid long, embedding array<double>, label {dict(rows.dtypes)['label']}, many long, " + ", ".join(f"{c} long" for c in cell)).withColumn("d", F.size("embedding")), "cells")
    of = ["label", "d", *cell]
    tiles = celled.groupBy(of).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = celled.join(tiles, of).withColumn("tile", F.pmod(F.xxhash64("cid", F.lit(1)), "tiles").cast("int"))
    # every row meets the tiles of its own cell and of those around it; each pair of tiles is one task's group
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * CELL_AXES), axis=-1).reshape(-1, CELL_AXES).tolist()
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s{k}") for k, v in enumerate(s)]) for s in steps])).alias("step")
    near = placed.select("*", step)
    for k, c in enumerate(cell):
        near = near.withColumn(f"n{k}", F.col(c) + F.col(f"step.s{k}"))
    around = tiles.select("label", "d", *[F.col(c).alias(f"n{k}") for k, c in enumerate(cell)], F.col("tiles").alias("their"))
    met = near.join(around, ["label", "d", *[f"n{k}" for k in range(CELL_AXES)]]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("their") - 1)))
    mine, theirs = F.struct(*[F.col(c) for c in cell], F.col("tile").alias("t")), F.struct(*[F.col(f"n{k}").alias(c) for k, c in enumerate(cell)], F.col("other").alias("t"))
    sided = met.select("label", "d", F.least(mine, theirs).alias("p"), F.greatest(mine, theirs).alias("q"), F.when(mine == theirs, 0).otherwise((mine > theirs).cast("int")).alias("second"), (mine == theirs).alias("own"), "cid", "many", "embedding")
    sided = sided.select("label", "d", "p", "q", F.col("p.t").alias("t1"), F.col("q.t").alias("t2"), "second", "own", "cid", "many", "embedding")
    found = work.put(sided.groupBy("label", "d", "p", "q").applyInArrow(_compared(lambda: shared.value, threshold), "cid long, links long, least long"), "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    # the classes of an id's vectors are one node
    held = good.where("id is not null").groupBy("id").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi")
    same = good.join(held.select("id", "lo"), "id").select(F.col("cid").alias("a"), F.col("lo").alias("b")).where("a <> b")
    labels = components(work, found.where("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b")).union(same))
    per_class = classes.select("cid", "id", "many").join(counts, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = per_class.groupBy("component").agg(F.min("id").alias("least"))
    per_class = per_class.join(least, "component").select("cid", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "least")
    own = all_rows.select("id", F.when(usable, F.xxhash64("label", "embedding")).alias("cid"))
    # the least class of a node also names rows of it that link with nothing
    named = own.join(per_class, "cid", "left")
    other = work.put(named.where("id is not null").groupBy("id").agg(F.min(F.coalesce("least", "id")).alias("node")).where("node < id"), "nodes")
    component = F.coalesce("node", "id")
    out = named.join(other, "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(component, "least").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
