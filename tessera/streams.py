"""Queries that read the test tables as streams, and their SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .sources import staging
from .streaming import intake


def _target(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{staging.shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _schema(spark: SparkSession, sf_dir: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{sf_dir}/events.parquet").schema)


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) n from events group by 1, 2")
def stm01_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = intake.folder_counts(spark, sf_dir, _schema(spark, sf_dir), _target(spark, "stream"), glob="events.parquet")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by 1")
def src18_newest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.latest_by_key(spark, sf_dir, _schema(spark, sf_dir), _target(spark, "stream"), glob="events.parquet", key="user_id", order="event_id", value="event_type")


#: Hours without a change after which a file is complete.
QUIET = 12


@query(f"""with e as (select cast(user_id as varchar) path, epoch_ms(ts) t, case when event_type <> 'error' then cast(floor(value / 100) as bigint) end size, epoch_ms(max(ts) over ()) last_t from events),
n as (select *, lead(t) over (partition by path order by t, coalesce(size, -1)) nxt, sum(case when size is null then 1 else 0 end) over (partition by path order by t, coalesce(size, -1) rows unbounded preceding) life from e),
r as (select *, t + {QUIET * 3600000} done from n where size > 0 and coalesce(t + {QUIET * 3600000} <= nxt, t + {QUIET * 3600000} < last_t))
select path, size, done // 60000 as minute from r qualify row_number() over (partition by path, life order by t) = 1""")
def stm01_file_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of files, dropped in four parts one after another: the stream goes on after each, and keeps what waits in between.

    All files of a part are one batch, as the changes of a path must not come after the watermark has passed them.
    """
    target = _target(spark, "changes")
    changes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") != "error", F.floor(F.col("value") / 100)).alias("size"))
    low, high = changes.agg(F.min("at"), F.max("at")).first() or (None, None)
    for k in range(4):
        part = F.least(F.lit(3), F.floor(F.expr(f"4 * (unix_millis(at) - unix_millis(timestamp'{low}')) / greatest(1, unix_millis(timestamp'{high}') - unix_millis(timestamp'{low}'))"))) if low else F.lit(0)
        changes.where(part == k).write.mode("append").parquet(f"{target}/in")
        stream = spark.readStream.schema(changes.schema).parquet(f"{target}/in")
        out = intake.appended(intake.stable_files(stream, quiet=QUIET * 3600), f"{target}/out")
    return out.select("path", "size", F.expr("unix_millis(ready_at) div 60000").alias("minute"))


@query("select s_suppkey, length(s_name) + 1 as length, sha256(s_name || chr(10)) digest from supplier")
def src18_dropped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, read as a stream of whole files.  The table is small and its files are many, so all cores write them."""
    target = _target(spark, "drop")
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_name").alias("value"))
    names.repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey").write.partitionBy("s_suppkey").text(f"{target}/in")
    files = intake.appended(intake.dropped_files(spark, f"{target}/in", "*.txt"), f"{target}/out")
    return files.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"), F.col("length"), "digest")
