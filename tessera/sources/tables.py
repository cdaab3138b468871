"""Stored tables: Parquet files by bucket of a key, and a log of snapshots that says which files are the table.

A change rewrites the buckets that its keys fall into and nothing else.  A snapshot is a small file written last, under a number
that must be free: until it is there, readers see the table as it was, and of two writers one is told.  Older snapshots stay readable.
A change may carry the name of its batch; a batch that is already in the log changes nothing, so a stream's batches can be run again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer made the next snapshot first."""


class StoredTable:
    """A table at a path, by key columns.  Paths must be in a store whose rename does not replace files."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], *, buckets: int = 16) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._path("snapshots")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def snapshot(self, version: int | None = None) -> dict:
        """What a snapshot says, the newest one by default; an empty table before the first."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "files": {}, "batches": [], "schema": None}
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        line = self.spark.read.text(f"{self.path}/snapshots/{version or known[-1]:08d}.json").first()
        return json.loads(line.value)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or those of some buckets."""
        found = self.snapshot(version)
        if found["schema"] is None:
            raise ValueError("the table has no version yet")
        schema = StructType.fromJson(found["schema"])
        files = [f"{self.path}/{f}" for b, f in sorted(found["files"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        return name

    def _commit(self, base: dict, files: dict[str, str], schema: dict, batch: str | None) -> int:
        version = base["version"] + 1
        text = json.dumps({"version": version, "files": files, "batches": [*base["batches"], *([batch] if batch else [])], "schema": schema})
        (draft, fs), (final, _) = self._path(f"snapshots/.{uuid.uuid4().hex}"), self._path(f"snapshots/{version:08d}.json")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} was written meanwhile")
        return version

    def _there(self, name: str) -> dict[str, str]:
        folder, fs = self._path(name)
        return {s.getPath().getName().split("=")[1]: f"{name}/{s.getPath().getName()}" for s in fs.listStatus(folder) if "=" in s.getPath().getName()}

    def merge(self, changes: DataFrame, *, gone: Column | None = None, batch: str | None = None, base: dict | None = None) -> int:
        """Writes changes by key and returns the version: a row replaces the one with its key or is added; where gone holds, the key's row goes.

        Of several changes of a key the greatest row counts.  base is the snapshot that the changes were made from, the newest by
        default; if there is a newer one by the time of writing, Conflict is raised and the table is as it was.
        """
        base = base or self.snapshot()
        if batch is not None and batch in base["batches"]:
            return base["version"]
        own = [c for c in changes.columns if c not in self.key]
        marked = changes.withColumn("_gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        each = marked.groupBy(*self.key).agg(F.max(F.struct(*own, "_gone")).alias("_new"))
        files, schema = dict(base["files"]), base["schema"] or changes.schema.jsonValue()
        touched = [r.b for r in each.select(self._bucket().alias("b")).distinct().collect()]  # at most the number of buckets
        if base["schema"]:
            held = [f"{self.path}/{files[str(b)]}" for b in touched if str(b) in files]
            kind = StructType.fromJson(base["schema"])
            old = (self.spark.read.schema(kind).parquet(*held) if held else self.spark.createDataFrame([], kind)).select(*self.key, F.struct(*own).alias("_old"))
            both = old.join(each, self.key, "full")
        else:
            both = each.withColumn("_old", F.lit(None).cast(changes.select(F.struct(*own).alias("s")).schema["s"].dataType))
        left = both.where(~F.coalesce("_new._gone", F.lit(False)))
        rows = left.select(*self.key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in own]).select(*changes.columns)
        written = self._there(self._write(rows))
        for b in touched:
            files.pop(str(b), None)
        return self._commit(base, files | written, schema, batch)

    def restore(self, version: int) -> int:
        """Makes an older version the newest one; no file is written anew."""
        base, old = self.snapshot(), self.snapshot(version)
        return self._commit(base, old["files"], old["schema"], None)


def delete_cascading(parents: StoredTable, children: StoredTable, keys: DataFrame, foreign: str) -> tuple[int, int]:
    """Deletes parents by key with the children that name them in the foreign column, these first; the two new versions."""
    (key,) = parents.key
    orphans = children.read().join(keys.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi").select(*children.read().columns)
    gone = parents.read().join(keys.select(key).distinct(), key, "left_semi").select(*parents.read().columns)
    second = children.merge(orphans, gone=F.lit(True))
    return parents.merge(gone, gone=F.lit(True)), second
