"""Queries of candidates, chunks, routing, listings and evaluation over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import candidates, joins, sequences
from .registry import money, query, table
from .sources import payloads

CAND_SQL = "c as (select o_custkey doc_id, cast(o_orderkey as varchar) service_id from orders), f as (select distinct o_custkey doc_id, cast(o_orderkey as varchar) service_id from orders where o_totalprice > 60000), m as (select * from c anti join f using (doc_id, service_id))"


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("service_id"), "o_totalprice")
    return rows.drop("o_totalprice"), rows.where("o_totalprice > 60000")


@query(f"with {CAND_SQL} select doc_id, service_id from m")
def rec06_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.missed(*_candidates(spark, sf_dir))


@query(f"""with {CAND_SQL}, n as (select doc_id, count(*) candidates from c group by 1), x as (select doc_id, count(*) missing, array_to_string(list_sort(list(service_id) filter (r <= 10)), ', ') examples from (select *, row_number() over (partition by doc_id order by service_id) r from m) group by 1)
select doc_id, candidates, coalesce(missing, 0) missing, coalesce(examples, '') examples, round(1 - coalesce(missing, 0) / candidates, 4) confidence from n left join x using (doc_id)""")
def rec07_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_rows, found = _candidates(spark, sf_dir)
    return candidates.completeness(all_rows, candidates.missed(all_rows, found))


@query("""select l_orderkey, l_linenumber, l_partkey, coalesce(case when l_suppkey % 2 = 0 then l_returnflag end, o_orderstatus) flag from lineitem left join orders on l_orderkey = o_orderkey""")
def jn15_candidate_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 2 == 0, F.col("l_returnflag")).alias("flag"))
    defaults = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("flag"))
    return candidates.with_defaults(rows, defaults, ["l_orderkey"], ["flag"])


@query("""select distinct a.p_brand place, a.p_partkey partkey from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_type <> b.p_type where a.p_size > 40 and b.p_size > 40""")
def jn18_ownership_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share brand and size with one of another type: by counts of types, not by pairs."""
    parts = table(spark, sf_dir, "part").where("p_size > 40")
    shared = parts.groupBy("p_brand", "p_size").agg(F.count_distinct("p_type").alias("n")).where("n > 1")
    return parts.join(shared, ["p_brand", "p_size"]).select(F.col("p_brand").alias("place"), F.col("p_partkey").alias("partkey")).distinct()


@query("""select s_suppkey, n_name as country from supplier join nation on lower(trim(n_name)) = lower(trim(case when s_suppkey % 2 = 0 then upper(n_name) else ' ' || n_name end)) and s_nationkey = n_nationkey""")
def jn25_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    named = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper("n_name")).otherwise(F.concat(F.lit(" "), "n_name")).alias("alias"))
    by_name = nations.select(F.lower(F.trim("n_name")).alias("name"), F.col("n_name").alias("country"))
    return named.withColumn("name", F.lower(F.trim("alias"))).join(by_name, "name").select("s_suppkey", "country")


@query("""with recursive x as materialized (select doc_id, string_split(text, chr(10)) l from documents where text is not null), r as materialized (select doc_id, cast(unnest(range(0, len(l))) as bigint) seq, unnest(list_transform(l, lambda t: length(t) + 1)) size from x),
s as materialized (select *, sum(size) over (partition by doc_id order by seq) e from r),
nx as materialized (select a.doc_id, a.seq, min(j.seq) nxt from s a join s b on b.doc_id = a.doc_id and b.seq = greatest(a.seq - 2, 0) join s j on j.doc_id = a.doc_id and j.seq > a.seq and j.e > b.e - b.size + 4000 group by 1, 2),
c(doc_id, chunk, seq) as (select doc_id, cast(1 as bigint), cast(0 as bigint) from x union all select c.doc_id, chunk + 1, nxt from c join nx on nx.doc_id = c.doc_id and nx.seq = c.seq),
b as (select c.doc_id, chunk, greatest(c.seq - 2, 0) lo, coalesce(lead(c.seq) over (partition by c.doc_id order by chunk) - 1, len(l) - 1) hi from c join x using (doc_id))
select doc_id, chunk, unnest(range(lo, hi + 1)) seq from b""")
def win17_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return candidates.chunks(lines.select("doc_id", F.col("seq").cast("long").alias("seq"), (F.length("line") + 1).cast("long").alias("size")), 4000, 2)


@query("""with t as (select conv_id, turn, case when turn % 3 = 1 then ' ' else text end x from conversations), f as (select *, nullif(trim(x), '') y from t)
select conv_id, turn, first_value(y ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) as next, last_value(y ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous from f""")
def win19_next_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("x"))
    return candidates.next_filled(rows, ["conv_id"], "turn", "x").select("conv_id", "turn", "next", "previous")


@query("""with d as (select user_id, datediff('day', date '1970-01-01', cast(ts as date)) as day, list_sort(list(distinct event_type)) sig from events group by 1, 2),
b as (select *, case when lag(day) over w = day - 1 and len(list_intersect(sig, lag(sig) over w)) >= 0.6 * least(len(sig), len(lag(sig) over w)) then 0 else 1 end brk from d window w as (partition by user_id order by day))
select user_id, cast(day as bigint) as day, cast(sum(brk) over (partition by user_id order by day rows unbounded preceding) as bigint) run from b""")
def win13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("sig"))
    return sequences.runs(days, ["user_id"], "day", "sig").select("user_id", "day", "run")


@query("""with n as (select c_nationkey, case when c_acctbal > 0 then 'credit' else 'debit' end side, count(*) n from customer group by 1, 2), a as (select *, sum(n) over (partition by c_nationkey) t from n)
select c_nationkey, side, n, r as rank from (select *, row_number() over (partition by c_nationkey order by n desc, side) r from a where n >= greatest(1, t // 2)) where r <= 2""")
def agg20_stable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.stable_values(table(spark, sf_dir, "customer").withColumn("side", F.when(F.col("c_acctbal") > 0, "credit").otherwise("debit")), ["c_nationkey"], "side")


@query("select coalesce(case when event_type <> 'view' then event_type end, 'unknown') model, count(*) calls, cast(sum(cast(value as decimal(18,2))) as decimal(18,2)) cost from events group by 1")
def agg12_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("unknown"))
    return table(spark, sf_dir, "events").groupBy(model.alias("model")).agg(F.count("*").alias("calls"), F.sum(money("value")).cast("decimal(18,2)").alias("cost"))


@query("""select strftime(date_trunc('month', ts), '%Y-%m') as month, count(*) calls, count(*) filter (event_type = 'error') errors, cast(coalesce(sum(cast(value as decimal(18,2))) filter (event_type = 'purchase'), 0) as decimal(18,2)) purchases, count(distinct user_id) users from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1""")
def agg10_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-01 00:00:00' and ts < timestamp_ntz '2024-02-01 00:00:00'")
    purchases = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", money("value"))), F.lit(0)).cast("decimal(18,2)")
    return month.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), purchases.alias("purchases"), F.count_distinct("user_id").alias("users"))


@query("""select c_nationkey, count(*) n, count(*) filter (c_acctbal > 0) credit, count(*) filter (c_acctbal <= 0) debit from customer group by 1""")
def agg24_group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("credit"), F.count_if(F.col("c_acctbal") <= 0).alias("debit"))


@query("""select conv_id, left(string_agg(text, '; ' order by turn), 500) description from conversations group by 1""")
def agg31_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: x["t"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.substring(F.array_join(parts, "; "), 1, 500).alias("description"))


@query("""select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by abs(o_totalprice - 100000), o_orderkey) = 1""")
def srt11_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.abs(F.col("o_totalprice") - 100000), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_size desc, p_partkey desc) = 1""")
def srt02_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_size").desc(), F.col("p_partkey").desc()]).select("p_brand", "p_partkey")


@query("""select p_partkey, case when s = 'approved' and row_number() over (partition by p_brand, s = 'approved' order by p_partkey desc) > 1 then 'retired' else s end status from (select *, case when p_size % 3 = 0 then 'approved' else 'candidate' end s from part)""")
def dml04_one_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "part").withColumn("status", F.when(F.col("p_size") % 3 == 0, "approved").otherwise("candidate"))
    return candidates.one_approved(models, "p_brand", "p_partkey", "status").select("p_partkey", "status")


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'ai' when o_orderstatus = 'F' then 'model' when o_orderkey % 2 = 0 then 'rules_first' when o_custkey % 2 = 0 then 'candidate' else 'ai' end path from orders""")
def rte02_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, "p").alias("profile"), (F.col("o_orderstatus") == "F").alias("has_approved"), (F.col("o_orderkey") % 2 == 0).alias("rules_first"), (F.col("o_custkey") % 2 == 0).alias("has_candidate"))
    return candidates.routed(docs).select("o_orderkey", "path")


@query("""with f as (select s_suppkey, 'invoice ' || s_nationkey as name, cast(s_suppkey % 3 as varchar) as digest from supplier), g as (select name, digest, min(s_suppkey) first from f group by 1, 2), n as (select *, row_number() over (partition by name order by first, digest) - 1 k from g)
select s_suppkey, name, case when k = 0 then name else name || ' (' || k || ')' end delivered from f join n using (name, digest)""")
def snk08_delivered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("invoice "), F.col("s_nationkey")).alias("name"), (F.col("s_suppkey") % 3).cast("string").alias("digest"))
    return candidates.delivered_names(files, "name", "digest", F.col("s_suppkey")).select("s_suppkey", "name", "delivered")


@query(r"""select page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .'), ''), 'output') as name from pages""")
def snk19_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", candidates.safe_name(F.col("url")).alias("name"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) amount from events")
def src13_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.typed(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k long", {"k": "amount"}).select("event_id", "amount")


@query("""select doc_id, len(t) n_tokens, array_to_string(t[1:20], ' ') tokens from (select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '' and not regexp_matches(x, '[0-9]')))) t from documents)""".replace("\\\\", "\\"))
def agg36_structural_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: (x != "") & ~x.rlike("[0-9]"))))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 20), " ").alias("tokens"))


@query(r"""select page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') token, case when contains(lower(url), 'http') or contains(lower(url), 'www') then true else false end marked from pages""")
def str14_header_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.lower("url"), "[^a-z0-9]", "").alias("token"), text.has_any(F.col("url"), "http, www").alias("marked"))
