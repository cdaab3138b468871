"""File intake and event streams on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dropped_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A stream of new files: path, digest and size.  Files must be moved into the folder whole; empty ones wait for content."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.where("length > 0").select("path", "modificationTime", "length", F.sha2("content", 256).alias("digest"))


def event_counts(events: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type, with a watermark, so state is bounded by the lateness allowed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def folder_counts(spark: SparkSession, folder: str, schema: str, target: str, *, glob: str, window: str = "1 hour") -> DataFrame:
    """Counts by window and type of the events in all files of a folder that are there now, read as a stream.

    Each micro-batch replaces the counts so far at `target`, so a batch that is run again after a failure changes
    nothing; the checkpoint beside it says which files are done, and a later call reads only new ones.
    """
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    counts = event_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), window=window)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/counts")

    stream = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{target}/counts")


def latest_by_key(spark: SparkSession, folder: str, schema: str, target: str, *, glob: str, key: str, order: str, value: str) -> DataFrame:
    """The newest value of each key of a folder's events, folded batch by batch into a table: each batch is merged with what is there, newest wins, so a repeated batch changes nothing."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    newest = events.groupBy(key).agg(F.max_by(F.struct(order, value), order).alias("n"))

    def replace(batch: DataFrame, _: int) -> None:
        batch.select(key, "n.*").write.mode("overwrite").parquet(f"{target}/newest")

    stream = newest.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{target}/newest")


def _settled(quiet_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, since = state.get if state.exists else (None, 0)  # of the file that is watched; no size: it is gone or was handed on
        ready: list[tuple[int, int]] = []

        def settle(until: int) -> None:
            nonlocal size
            if size is not None and size > 0 and since + quiet_ms <= until:
                ready.append((size, since + quiet_ms))
                size = -1  # handed on: later changes are no new file until it has vanished

        if state.hasTimedOut:
            settle(state.getCurrentWatermarkMs())
        rows = sorted((int(t.value) // 1_000_000, -1 if s is None or s != s else int(s)) for b in batches for t, s in zip(b["at"], b["size"], strict=True))
        for at, now in rows:
            settle(at)
            if now < 0:
                size, since = None, at
            elif size != -1:
                size, since = now, at
        if size is not None and size > 0:
            state.update((size, since))
            state.setTimeoutTimestamp(max(since + quiet_ms, state.getCurrentWatermarkMs() + 1))
        elif size is not None:  # an empty one waits for a change, one handed on for its end
            state.update((size, since))
        elif state.exists:
            state.remove()
        if ready:
            yield pd.DataFrame({"path": key[0], "size": [s for s, _ in ready], "ready_at": [pd.Timestamp(t, unit="ms") for _, t in ready]})

    return run


def stable_files(changes: DataFrame, *, quiet: int, late: str = "0 seconds") -> DataFrame:
    """A stream of files (path, size, ready_at) that may be read, from a stream of changes (path, at, size); a null size says that a file is gone.

    A file is handed on once, `quiet` seconds after its last change if it is not empty; a change in between starts the wait anew, an
    empty file waits, one that vanishes is forgotten and may come again.  Waiting is a timer on the watermark, so a file needs
    no further change to leave.  Changes of a path at the same time count by size.  State is one row for each file that is there.
    """
    marked = changes.select(F.col("path").cast("string").alias("path"), "at", F.col("size").cast("long").alias("size")).withWatermark("at", late)
    return marked.groupBy("path").applyInPandasWithState(_settled(quiet * 1000), "path string, size long, ready_at timestamp", "size long, since long", "append", GroupStateTimeout.EventTimeTimeout)


def appended(stream: DataFrame, target: str) -> DataFrame:
    """The rows of a stream, run on all that is there now, from the table they are appended to; a second call goes on where this one ended."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{target}/rows").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{target}/rows")
