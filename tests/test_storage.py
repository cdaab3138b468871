"""Stored tables, delivery and the stream of stable files."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources.delivered import Delivery
from tessera.sources.tables import Conflict, StoredTable, delete_cascading
from tessera.streaming import intake

SHAPE = "k long, v string, n int"


def test_merges_rewrite_only_the_buckets_of_their_keys(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    with pytest.raises(ValueError):
        t.read()
    assert t.merge(spark.createDataFrame([(i, f"v{i}", 0) for i in range(50)], SHAPE)) == 1
    before = t.snapshot()["files"]
    assert t.merge(spark.createDataFrame([(7, "new", 1), (7, "old", 0), (99, None, None)], SHAPE)) == 2
    after = t.snapshot()["files"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2
    rows = {r.k: (r.v, r.n) for r in t.read().collect()}
    assert len(rows) == 51 and rows[7] == ("old", 0) and rows[99] == (None, None) and rows[8] == ("v8", 0)  # the greatest of a key's rows
    assert {r.k: r.v for r in t.read(1).collect()}[7] == "v7"
    assert t.merge(spark.createDataFrame([(7, "x", 0), (12345, "x", 0)], SHAPE), gone=F.lit(True)) == 3
    assert 7 not in {r.k for r in t.read().collect()} and t.read().count() == 50
    assert t.restore(1) == 4 and t.read().count() == 50 and t.versions() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        t.read(9)


def test_of_two_writers_one_is_told(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), ["k"])
    t.merge(spark.createDataFrame([(1, "a", 0)], SHAPE))
    base = t.snapshot()
    t.merge(spark.createDataFrame([(2, "b", 0)], SHAPE))
    with pytest.raises(Conflict):
        t.merge(spark.createDataFrame([(3, "c", 0)], SHAPE), base=base)
    assert {r.k for r in t.read().collect()} == {1, 2}
    assert not [f for f in os.listdir(tmp_path / "t" / "snapshots") if f.endswith(".json") is False and not f.endswith(".crc")]


def test_a_batch_counts_once_and_empty_changes_are_versions(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), ["k", "v"])
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3)], SHAPE)
    assert t.merge(rows, batch="one") == 1
    assert t.merge(rows.withColumn("n", F.lit(9)), batch="one") == 1
    assert t.merge(rows.limit(0), batch="two") == 2
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted([(1, "a", 1), (1, "b", 2), (None, "c", 3)], key=str)
    assert t.merge(rows, gone=F.col("n") < 9) == 3 and t.read().count() == 1  # a null key equals no other


def test_children_go_with_their_parents(spark, tmp_path):
    parents, children = StoredTable(spark, str(tmp_path / "p"), ["k"]), StoredTable(spark, str(tmp_path / "c"), ["id"])
    parents.merge(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], SHAPE))
    children.merge(spark.createDataFrame([(10, 1), (11, 2), (12, 1), (13, None)], "id long, parent long"))
    assert delete_cascading(parents, children, spark.createDataFrame([(1,), (5,)], "k long"), "parent") == (2, 2)
    assert {r.k for r in parents.read().collect()} == {2} and {r.id for r in children.read().collect()} == {11, 13}


def test_names_are_kept_across_batches_and_a_broken_batch_is_finished(spark, tmp_path, monkeypatch):
    d = Delivery(spark, str(tmp_path / "d"), "k")
    shape = "k long, name string, digest string"
    d.deliver(spark.createDataFrame([(1, "a.txt", "x"), (2, "a.txt", "y"), (3, "a.txt", "x"), (4, "b", "x")], shape), "one")
    second = spark.createDataFrame([(5, "a.txt", "z"), (6, "a.txt", "y"), (7, "b", "w")], shape)
    real = d.files.merge
    monkeypatch.setattr(d.files, "merge", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        d.deliver(second, "two")
    monkeypatch.setattr(d.files, "merge", real)
    for _ in range(2):
        d.deliver(second, "two")
    assert {r.k: r.file for r in d.documents.read().collect()} == {1: "a.txt", 2: "a (2).txt", 3: "a.txt", 4: "b", 5: "a (3).txt", 6: "a (2).txt", 7: "b (2)"}
    assert d.files.read().count() == 5


def test_files_leave_once_they_stand_still(spark, tmp_path):
    """Two runs over the same folders: what waits between them is kept."""
    shape, at = "path string, at timestamp, size long", lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"

    def drop(rows):
        spark.createDataFrame([(p, at(s), n) for p, s, n in rows], "path string, at string, size long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return {(r.path, r.size, r.ready_at.strftime("%M:%S")) for r in intake.appended(intake.stable_files(stream, quiet=60), str(tmp_path / "out")).collect()}

    drop([("grows", 0, 1), ("grows", 50, 2), ("still", 0, 5), ("empty", 0, 0), ("gone", 10, 3), ("gone", 40, None)])
    first = run()
    assert first == set()
    drop([("tick", 90, 1)])
    assert run() == {("still", 5, "01:00")}
    drop([("tick", 200, 1), ("still", 200, 6), ("empty", 201, 4), ("gone", 202, 8), ("still", 203, None), ("still", 204, 7)])
    drop([("tick", 400, 2)])
    assert run() == {("still", 5, "01:00"), ("grows", 2, "01:50"), ("empty", 4, "04:21"), ("gone", 8, "04:22"), ("still", 7, "04:24"), ("tick", 1, "02:30")}
