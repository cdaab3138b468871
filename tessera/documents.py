"""Queries of row rules, scalars, grades and upkeep over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import amounts, text
from .operators import delivery, evaluation
from .operators import rows as r
from .registry import money, query, table
from .sources import folders, payloads, words

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINE_SQL = ", ".join(LINE_ORDER)


@query("""with s as (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) net from lineitem group by 1)
select o_orderkey, net, cast(net - cast(o_totalprice as decimal(18,2)) as decimal(18,2)) variance, round(abs(cast(net - cast(o_totalprice as decimal(18,2)) as double)) / abs(o_totalprice), 6) variance_pct, abs(cast(net - cast(o_totalprice as decimal(18,2)) as double)) / abs(o_totalprice) <= 0.01 ok from orders join s on o_orderkey = l_orderkey""")
def rec02_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).cast("decimal(18,2)").alias("net"))
    both = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("subtotal")).join(sums, "o_orderkey")
    return r.anchored(both, "net", "subtotal").select("o_orderkey", "net", "variance", F.round("variance_pct", 6).alias("variance_pct"), "ok")


@query(f"""with i as (select *, sum(case when l_returnflag <> 'R' then 1 else 0 end) over (partition by l_orderkey order by {LINE_SQL} rows unbounded preceding) item from lineitem),
t as (select *, sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,2)) end) over (partition by l_orderkey, item) tax from i)
select l_orderkey, l_linenumber, l_partkey, cast(coalesce(tax, 0) as decimal(18,2)) tax from t where l_returnflag <> 'R'""")
def agg33_tax_to_open_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.accumulated(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER, F.col("l_returnflag") != "R", money("l_extendedprice"), "tax")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "tax")


@query("""with t as (select conv_id, turn, case when length(text) % 5 = 0 then 0 when role = 'assistant' then 1 when length(text) > 200 then 2 end tier from conversations)
select conv_id, turn from t where tier is not null qualify row_number() over (partition by conv_id order by tier, turn desc) = 1""")
def win23_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = [F.length("text") % 5 == 0, F.col("role") == "assistant", F.length("text") > 200]
    return r.footers(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", tiers).select("conv_id", "turn")


@query("""with b as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) block from conversations),
s as (select *, sum(case when role <> 'user' and length(text) % 4 = 0 then 1 else 0 end) over (partition by conv_id, block order by turn rows unbounded preceding) stops from b)
select conv_id, turn from s where block > 0 and role <> 'user' and stops = 0""")
def win25_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.continuations(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", F.length("text") % 4 == 0).select("conv_id", "turn")


@query("""select l_orderkey, case when min(round(l_tax, 4)) = max(round(l_tax, 4)) then min(round(l_tax, 4)) end rate from lineitem group by 1""")
def agg21_consistent_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.consistent(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_tax"))


@query("""select p_brand, case when bool_and(p_size % 5 > 0) then 'verified' when bool_or(p_size % 5 > 0) then 'review' else 'failed' end grade, count(*) samples, bool_and(p_size % 5 > 0) and count(*) >= 2 approvable from part group by 1""")
def agg29_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.grades(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size") % 5)


@query("""select count(*) n, count(*) filter (quality = 1) passed, round(avg(quality), 4) mean_score, sum(toxic) hallucinations, round(100.0 * count(*) filter (toxic = 0) / count(*), 1) clean_pct from labels""")
def agg15_eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.count_if(F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"), F.round(F.avg("quality"), 4).alias("mean_score"), F.sum("toxic").alias("hallucinations"), F.round(100.0 * clean / F.count("*"), 1).alias("clean_pct"))


@query("""select o_custkey, cast(sum(try_cast(v as decimal(18,2))) as decimal(18,2)) excluded from (select o_custkey, case when o_orderkey % 3 = 0 then 'n/a' else cast(cast(o_totalprice as decimal(18,2)) as varchar) end v from orders) group by 1""")
def agg02_excluded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(money("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(printed.try_cast("decimal(18,2)")).cast("decimal(18,2)").alias("excluded"))


@query("""select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 30""")
def srt15_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return r.kept_runs(runs, "at", 30).select("o_orderkey")


@query("""select o_orderkey from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 1""")
def srt16_next_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("""select o_orderkey, case when o_orderstatus = 'O' and epoch(timestamp '1998-01-01') - epoch(o_orderdate) > 86400 * 365 then 'failed' when o_orderstatus = 'O' then 'running' else 'done' end status from orders""")
def stm07_stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    return r.swept(jobs, "status", "at", now, 86400 * 365).select("o_orderkey", "status")


@query("""select c_custkey, c_name from customer where c_custkey % 10 <> 0 union all select c_custkey, upper(c_name) from customer where c_custkey % 10 = 0""")
def dml02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return r.upserted(old, old.where("c_custkey % 10 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("""select p_partkey, case when least(abs(p_size - 5), abs(p_size - 20), abs(p_size - 45)) = abs(p_size - 5) then 'small' when least(abs(p_size - 5), abs(p_size - 20), abs(p_size - 45)) = abs(p_size - 20) then 'medium' else 'large' end column_name from part""")
def jn11_nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", r.nearest(parts, "p_size", [("small", 5), ("medium", 20), ("large", 45)]).alias("column_name"))


@query(r"""select o_orderkey, printed, cast(regexp_extract(printed, '([\d.]+)', 1) as decimal(18,6)) as value from (select o_orderkey, '$' || cast(cast(o_totalprice as decimal(18,2)) as varchar) printed from orders)""")
def num05_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.concat(F.lit("$"), money("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", printed.alias("printed")).withColumn("value", amounts.cell_amount(F.col("printed")))


@query("""select l_orderkey, l_linenumber, l_partkey, cast(case when l_linenumber % 2 = 0 then l_tax * 100 when l_linenumber = 1 then 1 else l_tax end as decimal(18,6)) printed, cast(case when cast(case when l_linenumber % 2 = 0 then l_tax * 100 when l_linenumber = 1 then 1 else l_tax end as decimal(18,6)) > 1 then cast(case when l_linenumber % 2 = 0 then l_tax * 100 when l_linenumber = 1 then 1 else l_tax end as decimal(18,6)) / 100 else cast(case when l_linenumber % 2 = 0 then l_tax * 100 when l_linenumber = 1 then 1 else l_tax end as decimal(18,6)) end as decimal(18,6)) rate from lineitem""")
def num11_tax_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 100).when(F.col("l_linenumber") == 1, 1).otherwise(F.col("l_tax")).cast("decimal(18,6)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", printed.alias("printed")).withColumn("rate", amounts.tax_rate(F.col("printed")))


@query("""select conv_id, cast(sum(length(text) // 4) as bigint) tokens, cast((sum(case when role = 'user' then length(text) // 4 else 0 end) * 25 + sum(case when role <> 'user' then length(text) // 4 else 0 end) * 100 + 5) // 10 / 1000000 as decimal(18,6)) cost from conversations group by 1""")
def num15_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.expr("length(text) div 4")
    read, written = (F.sum(F.when(c, tokens).otherwise(0)) for c in (F.col("role") == "user", F.col("role") != "user"))
    cost = (read.cast("decimal(18,0)") * F.lit("2.5").cast("decimal(4,1)") + written.cast("decimal(18,0)") * F.lit("10.0").cast("decimal(4,1)")) / 1000000
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(tokens).alias("tokens"), F.round(cost, 6).cast("decimal(18,6)").alias("cost"))


@query("""select s_suppkey, case when contains(lower(s_name), '#000000001') then 'first' when contains(lower(s_name), 'supplier') then 'known' else s_name end name from supplier""")
def str07_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.mapped(F.col("s_name"), {"#000000001": "first", "SUPPLIER": "known"}).alias("name"))


@query("""select event_id, case when lower(trim(event_type)) in ('view', 'click', 'error') then lower(trim(event_type)) else 'recurring' end charge_type from events""")
def str16_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.enumerated(F.col("event_type"), ("view", "click", "error"), "recurring").alias("charge_type"))


@query("""select user_id, array_to_string(list_transform(list_sort(list({'f': f, 't': event_type})), lambda x: x.t), ',') kinds from (select user_id, event_type, min({'a': ts, 'b': event_id}) f from events group by 1, 2) group by 1""")
def set03_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order in which they come first; the aggregate keeps one row a value, not the sequence."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query("""select a.doc_id, a.quality, case when lower(trim(case when a.doc_id % 2 = 0 then 'EN' else ' de ' end)) = d.lang then 1 else 0 end score from labels a join documents d using (doc_id)""")
def evl02_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("doc_id") % 2 == 0, "EN").otherwise(" de ")
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return both.select("doc_id", "quality", evaluation.same_text(guess, F.col("lang")).cast("int").alias("score"))


@query("""select c_custkey, to_json({'name': c_name, 'segment': c_mktsegment}) as payload from customer""")
def snk03_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return rows.select("c_custkey", payloads.canonical(["name", "segment"]).alias("payload"))


@query("""select l_orderkey, count(*) n_lines, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) total, count(distinct l_suppkey) suppliers, strftime(max(l_shipdate), '%Y-%m-%d') last_shipped from lineitem group by 1""")
def snk04_extraction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.extraction_log(table(spark, sf_dir, "lineitem"), "l_orderkey", money("l_extendedprice"), "l_suppkey", "l_shipdate")


@query("""select distinct conv_id, case when conv_id % 10 = 0 then 0 else max(turn) over (partition by conv_id) end pages from conversations""")
def src03_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for pages; of every tenth document none can be read."""
    c = table(spark, sf_dir, "conversations")
    return words.page_counts(c, c.where("conv_id % 10 <> 0"), "conv_id", "turn")


@query(r"""with s as (select string_split(regexp_replace(string_split(url, '?')[1], '^[a-z]+://', ''), '/') p from pages where url is not null), f as (select p[1:least(4, len(p) - 1)] p from s) select p[1] host, p[2] folder, count(*) files from f group by 1, 2""")
def src17_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.scanned(table(spark, sf_dir, "pages"), "url")


@query(r"""select doc_id, count(*) groundable from (select doc_id, unnest(regexp_split_to_array(text, '\s+')) x from documents) where regexp_matches(x, '\d[\d,]*\.\d\d') or (length(x) >= 6 and regexp_matches(x, '\d')) group by 1""")
def flt23_groundable(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("x"))
    return words.where(F.col("x").rlike(r"\d[\d,]*\.\d\d") | ((F.length("x") >= 6) & F.col("x").rlike(r"\d"))).groupBy("doc_id").agg(F.count("*").alias("groundable"))


@query("""select o_orderkey, case when o_custkey % 4 = 0 then 'no number' when n is null then 'no items' when total = 0 then 'all zero' when abs(total - o_totalprice) / o_totalprice > 0.01 then 'not reconciled' else 'ok' end reason from orders left join (select l_orderkey, count(*) n, sum(cast(l_extendedprice as decimal(18,2))) total from lineitem group by 1) on o_orderkey = l_orderkey""")
def flt27_output_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).alias("total"))
    return delivery.output_gate(table(spark, sf_dir, "orders"), sums, F.col("o_custkey") % 4 != 0, "o_totalprice", doc="o_orderkey")