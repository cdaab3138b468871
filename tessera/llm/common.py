"""Shared pieces of the training-data operators: staged tables, Arrow text access, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Arrow batches that Python functions are given while tables are written: rows, bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds Arrow batches within, so that long texts do not add up in a task; the session's own settings return after."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """Intermediate tables of one run of an operator, written as Parquet into the shared folder.

    A written table cuts lineage and survives lost executors.  The tables go when the session ends or
    when drop() is called, which callers may do once they have written the operator's result.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.drop)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        out = f"{self.path}/{self.n:02d}-{name}"
        with small_batches(self.spark):
            df.write.parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def remove(self, df: DataFrame) -> None:
        """Deletes the files of one table of this workspace that nothing reads any more."""
        for f in {x.rpartition("/")[0] for x in df.inputFiles() if self.path.rpartition("/")[2] in x}:
            self._delete(f)

    def sweep(self) -> None:
        """Lets Spark remove the shuffle files of finished jobs, which it does once their plans are collected as garbage.

        The scheduler keeps hold of its last job, so a small one with a plan comes first.
        """
        self.spark.range(1).groupBy("id").count().collect()
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self) -> None:
        atexit.unregister(self.drop)
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.path)
            except Exception:  # noqa: BLE001  the session may be gone already
                return


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where df has a column of that name."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        out.append(name)
    return out


#: Bytes of text that a kernel turns into wide numpy arrays at once, which fit caches then; one longer text is still taken whole.
SLICE_BYTES = 1 << 16


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes in `column`, so that memory does not depend on the batch size."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two rounds of xor-shift and multiply."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Modulus of the rolling hash, a Mersenne prime, and two pairs of fixed random bases.
PRIME = (1 << 31) - 1
BASES = ((1_390_208_153, 768_941_387), (1_905_110_467, 333_667_951))


def _folded(x: np.ndarray) -> np.ndarray:
    """A number below 2**32 that equals x modulo PRIME, or for x below 2**32 one of at most PRIME + 1."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


class Rolling:
    """Hashes of any ranges of a buffer from prefix sums of polynomials modulo a prime, two bases in 62 bits.

    Two unequal ranges of n items agree for at most n of the 2**31 choices of each base, whatever they hold.
    """

    _powers: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        found = cls._powers.get(base, np.ones(1, np.uint64))
        if len(found) < n:
            found, size = np.ones(1, np.uint64), max(n, SLICE_BYTES + 1)
            while len(found) < size:
                found = np.concatenate([found, found * np.uint64(pow(base, len(found), PRIME)) % np.uint64(PRIME)])
            if size <= 8 * SLICE_BYTES:
                cls._powers[base] = found
        return found

    def __init__(self, data: np.ndarray, pair: int = 0) -> None:
        n, self.parts = len(data), []
        values = data.astype(np.uint64) + np.uint64(1)
        for base in BASES[pair]:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_folded(values * self.powers(base, n + 1)[:n]), out=sums[1:])
            self.parts.append((sums, self.powers(pow(base, -1, PRIME), n + 1)))

    @staticmethod
    def _both(parts: list[np.ndarray]) -> np.ndarray:
        one, two = (_folded(_folded(x)) for x in parts)
        for x in (one, two):
            np.subtract(x, np.uint64(PRIME), out=x, where=x >= np.uint64(PRIME))
        return mix(one | (two << np.uint64(31)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._both([_folded(s[end] - s[start]) * down[start] for s, down in self.parts])

    def joined(self, start: np.ndarray, cut: np.ndarray, follow: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the items from start to cut with those from follow to end behind them."""
        return self._both([_folded(_folded(s[cut] - s[start]) * down[start]) + _folded(_folded(s[end] - s[follow]) * down[follow - cut + start]) for s, down in self.parts])


class Plain:
    """Hashes of ranges like Rolling's, modulo 2**64 and cheaper.  They only choose what is compared: equal ranges agree, but ranges made for it can agree as well."""

    BASE = 0x5851F42D4C957F2D
    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) >= n:
            return cls._powers
        both = []
        for base in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if n <= 8 * SLICE_BYTES:
            cls._powers = (both[0], both[1])
        return both[0], both[1]

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up, self.down = self.powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def joined(self, start: np.ndarray, cut: np.ndarray, follow: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the items from start to cut with those from follow to end behind them."""
        s, down = self.sums, self.down
        return mix((s[cut] - s[start]) * down[start] + (s[end] - s[follow]) * down[follow - cut + start])


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b).

    Every round takes the least label among neighbours, by an aggregate with map-side partials, then
    jumps to the label's own label, so paths halve.  Each round's labels are a written table; nothing
    but the number of changed labels comes to the driver.
    """
    both = work.put(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = work.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("top"))
        new = work.put(low.join(up, "c", "left").select("node", "before", F.least("c", F.coalesce("top", "c")).alias("component")), "labels")
        if new.where("component <> before").isEmpty():
            return new.select("node", "component")
        work.remove(labels)
        labels = new.select("node", "component")
        work.sweep()
