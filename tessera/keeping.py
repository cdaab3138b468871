"""Queries that store tables, change them and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .sources import staging
from .sources.delivered import Delivery
from .sources.tables import StoredTable, delete_cascading


def _stored(spark: SparkSession, name: str, key: list[str]) -> StoredTable:
    return StoredTable(spark, f"{staging.shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", key)


def _customers(spark: SparkSession, sf_dir: str) -> StoredTable:
    """Customers; then those who ordered get what they ordered on top, new ones come for each nation, and those in debt go."""
    stored, c = _stored(spark, "customers", ["c_custkey"]), table(spark, sf_dir, "customer")
    stored.merge(c, batch="load")
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    more = c.join(spent, "c_custkey").withColumn("c_acctbal", F.col("c_acctbal") + F.col("n")).select(*c.columns)
    new = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"), "n_nationkey", F.lit(0.0).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment")).toDF(*c.columns)
    stored.merge(more.union(new), batch="orders")
    stored.merge(c.where("c_acctbal < 0"), gone=F.lit(True), batch="debts")
    stored.merge(more, batch="orders")  # a batch that was there already
    return stored


CUSTOMERS_SQL = "m as (select c_custkey, c_name, c_nationkey, c_acctbal + coalesce(n, 0) c_acctbal, c_mktsegment from customer left join (select o_custkey c_custkey, count(*) n from orders group by 1) using (c_custkey) union all select -1 - n_nationkey, n_name, n_nationkey, 0.0, 'NEW' from nation)"


@query(f"with {CUSTOMERS_SQL} select * from m where c_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def dml02_stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).read()


@query(f"with {CUSTOMERS_SQL} select 1 as version, c.* from customer c union all select 2, m.* from m union all select 4, m.* from m")
def dml01_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two versions read back, and the second one restored as the fourth."""
    stored = _customers(spark, sf_dir)
    newest = stored.restore(2)
    one, two, four = (stored.read(v).select(F.lit(v).alias("version"), "*") for v in (1, 2, newest))
    return one.union(two).union(four)


@query("with gone as (select c_custkey from customer where c_acctbal < 0) select 'customer' as kind, c_custkey as key from customer where c_custkey not in (select c_custkey from gone) union all select 'order', o_orderkey from orders where o_custkey not in (select c_custkey from gone)")
def dml03_stored_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children, c = _stored(spark, "parents", ["c_custkey"]), _stored(spark, "children", ["o_orderkey"]), table(spark, sf_dir, "customer")
    parents.merge(c)
    children.merge(table(spark, sf_dir, "orders"))
    delete_cascading(parents, children, c.where("c_acctbal < 0"), "o_custkey")
    return parents.read().select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key")).union(children.read().select(F.lit("order"), "o_orderkey"))


FILES_SQL = r"""f as (select o_orderkey, o_orderstatus, regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g') || '.json' as name, md5(o_orderstatus || '|' || o_orderpriority) digest, min(o_orderkey) over (partition by o_orderstatus) batch from orders),
k as (select name, digest, row_number() over (partition by name order by min(batch), min(o_orderkey), digest) n, count(*) orders from f group by 1, 2)"""


def _delivery(spark: SparkSession, sf_dir: str) -> Delivery:
    """Orders delivered in a batch for each status, the first one twice."""
    done = Delivery(spark, f"{staging.shared_folder(spark)}/delivered-{uuid.uuid4().hex[:12]}", "o_orderkey")
    name = F.concat(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_"), F.lit(".json"))
    digest = F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority").cast("binary"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), digest.alias("digest"), "o_orderstatus")
    batches = [r.o_orderstatus for r in rows.groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("first")).orderBy("first").collect()]
    for status in [*batches, *batches[:1]]:
        done.deliver(rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), f"status-{status}")
    return done


@query(f"with {FILES_SQL} select o_orderkey, digest, case when n = 1 then name else replace(name, '.json', ' (' || n || ').json') end as file from f join k using (name, digest)")
def snk08_delivered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is returned is read from the store: each content has a file of its own, equal ones share it."""
    return _delivery(spark, sf_dir).documents.read().select("o_orderkey", "digest", "file")


@query(f"with {FILES_SQL} select name, digest, n from k")
def snk05_delivered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of files, which is written last."""
    return _delivery(spark, sf_dir).files.read()
