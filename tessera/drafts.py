"""Queries of authoring, retries and packages over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import ROWS_SQL, flag, rows
from .operators import authoring, delivery, evaluation, grouping, store
from .plans import executor, interpreter
from .registry import money, query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("select p_brand, case when min(case when p_size % 3 = 0 then p_size end) is not null then 'rule' when min(case when p_size % 3 = 1 then p_size end) is not null then 'label' else 'dropped' end source, coalesce(min(case when p_size % 3 = 0 then p_size end), min(case when p_size % 3 = 1 then p_size end)) p_size from part group by 1")
def aut02_repaired_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_size") % 3
    c = p.select("p_brand", "p_size", F.when(k == 0, "rule").otherwise("label").alias("kind"), F.when(k < 2, F.upper("p_brand")).otherwise("x").alias("output"))
    return authoring.repaired(c, p.select("p_brand", F.lower("p_brand").alias("target")).distinct(), "p_brand", "p_size", "output", "target")


@query("select n_nationkey, case when n_nationkey % 3 = 0 then 'hint' else n_name end label, n_regionkey as kind from nation")
def aut03_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("label"), F.col("n_regionkey").alias("kind"))
    hints = n.where("n_nationkey % 3 = 0").select("n_nationkey", F.lit("hint").alias("label"), F.lit(None).cast("long").alias("kind"))
    return authoring.hinted(n, hints, "n_nationkey", ["label", "kind"])


@query("with a as (select l_suppkey, l_linenumber n, bool_and(l_partkey % 40 <> 0) ok from lineitem where l_linenumber <= 3 group by 1, 2), s as (select l_suppkey, min(case when ok then n end) won, max(n) last from a group by 1) select l_suppkey, coalesce(won, last) tries, case when won is not null then 'saved' else 'failed' end state from s")
def aut04_train_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authoring.rounds(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", F.col("l_partkey") % 40 != 0)


@query("select l_orderkey, bool_and(l_partkey % 9 <> 0) verified from lineitem where l_linenumber <= 3 group by 1")
def aut05_sample_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(*LINE, "l_extendedprice")
    return authoring.sample_then_replay(x.where("l_linenumber <= 3"), x.where("l_partkey % 9 <> 0"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'draft' when n_nationkey % 3 = 0 then n_name end label from nation where n_nationkey % 2 = 0 or n_nationkey % 3 = 0")
def aut07_merged_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("label"))
    return authoring.merged_drafts(n.where("n_nationkey % 2 = 0").withColumn("label", F.lit("draft")), n.where("n_nationkey % 3 = 0"), ["n_nationkey"], ["label"])


@query("with m as (select *, max(case when event_type = 'view' then event_id end) over (partition by user_id) l from events) select user_id, count(*) turns, count(*) filter (event_type = 'view') extractions, max(case when event_type = 'click' and event_id > coalesce(l, -1) then event_id end) last_preview from m group by 1")
def aut09_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "extract").when(F.col("event_type") == "click", "preview").otherwise("turn")
    return authoring.session_log(table(spark, sf_dir, "events").withColumn("kind", kind), "user_id", "event_id", "kind")


@query("select doc_id, '## Language' || chr(10) || lang || case when source is not null then chr(10) || chr(10) || '## Source' || chr(10) || source else '' end as prompt from documents where trim(lang) <> ''")
def udf07_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("trim(lang) <> ''")
    return d.select("doc_id", authoring.prompt([("Language", F.col("lang")), ("Empty", F.lit(" ")), ("Source", F.col("source"))]).alias("prompt"))


@query("select o_orderkey, unnest(case when o_custkey % 9 > 1 then ['a', 'b'] else ['lost'] end) half from orders where o_orderkey % 3 = 0")
def udf05_chunk_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 9).alias("size"))
    return authoring.chunk_retries(r, "o_orderkey", "size", F.col("o_orderkey") % 3 != 0).select("o_orderkey", "half")


# The policies of a profile, one pipeline each, together.
@query(f"with {ROWS_SQL} select 'rows' as policy, doc_id, i from r where flag = 'R' and doc_id % 2 = 0 union all select 'charges', doc_id, i from (select *, last_value(case when flag = 'A' then part end ignore nulls) over (partition by doc_id order by i rows unbounded preceding) ident from r where doc_id % 2 = 1) where ident is not null and flag = 'N'")
def exp17_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    single = interpreter.grouped(r.where("doc_id % 2 = 0").withColumn("role", F.col("flag")), ("single", "R")).select(F.lit("rows").alias("policy"), "doc_id", "i")
    charges = grouping.charge_candidates(r.where("doc_id % 2 = 1"), ["doc_id"], ["i"], F.when(flag("A"), F.col("part")), F.when(flag("N"), F.col("price")))
    return single.union(charges.select(F.lit("charges"), "doc_id", "i"))


@query(f"with {ROWS_SQL}, k as (select *, coalesce(sum(case when flag = 'R' then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) era from r), o as (select *, max(case when flag = 'A' then 1 else 0 end) over (partition by doc_id, era order by i rows unbounded preceding) opened, max(case when flag = 'R' then 1 else 0 end) over (partition by doc_id, era) ends from k), g as (select *, dense_rank() over (partition by doc_id order by era) grp from o where opened = 1 and ends = 1) select doc_id, grp, arg_min(part, i) service_id, cast(max(price) filter (flag = 'R') as decimal(18,2)) amount from g group by 1, 2")
def exp16_grouped_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = grouping.total_groups(rows(spark, sf_dir), ["doc_id"], ["i"], flag("A"), flag("R"), F.lit(False))
    return held.groupBy("doc_id", F.col("group").alias("grp")).agg(F.min_by("part", "i").alias("service_id"), F.max(F.when(flag("R"), F.col("price"))).alias("amount"))


@query(f"with {ROWS_SQL} select doc_id, row_number() over (partition by doc_id order by i) line_number, cast(l_partkey as varchar) service_id from r where flag = 'A'")
def exp04_plan_from_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = executor.from_hints({"include": "^A ", "identifier_pattern": r"P(\d+)", "unknown": "x"})
    return executor.execute(rows(spark, sf_dir), plan).select("doc_id", "line_number", "service_id")


@query("select o_orderkey, case when o_orderstatus = 'P' then 'ai' when o_orderkey % 2 = 0 then 'rules' when o_orderkey % 3 = 0 then 'sample' else 'ai' end route from orders")
def rte05_rules_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = F.col("o_orderstatus") != "P"
    return evaluation.routes(table(spark, sf_dir, "orders"), [("rules", fit & (F.col("o_orderkey") % 2 == 0)), ("sample", fit & (F.col("o_orderkey") % 3 == 0))]).select("o_orderkey", "route")


@query("select user_id, case when arg_max(event_type, event_id) = 'error' then 'failed' when bool_or(event_type = 'purchase') then 'validated' else 'authored' end outcome from events group by 1")
def rte06_training_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.some(F.col("event_type") == "purchase").alias("bought"))
    return evaluation.routes(e, [("failed", F.col("last") == "error"), ("validated", F.col("bought"))], "authored").select("user_id", F.col("route").alias("outcome"))


@query(f"select {KEY}, cast(case when l_linenumber % 2 = 0 then l_linenumber / 100.0 end as decimal(18,6)) as cost from lineitem where l_returnflag = 'N'")
def snk11_cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs are logged where they are known; a call without one is logged all the same."""
    x = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    printed = F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_linenumber") / 100).cast("decimal(18,6)").cast("string")).otherwise("n/a")
    return x.select(*LINE, printed.try_cast("decimal(18,6)").alias("cost"))


@query("select l_orderkey, 'rows' as part, count(*) n from lineitem group by 1 union all select o_orderkey, 'manifest', 1 from orders")
def snk09_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a delivery in their order, the manifest last, as its presence says that the others are whole."""
    data = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.lit("rows").alias("part"), F.count("*").alias("n"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), money("o_totalprice").alias("total_due"))
    sums = data.select(F.col("l_orderkey").alias("doc_id"), F.col("n").alias("n_rows"), F.lit(0).cast("decimal(18,2)").alias("total"))
    return data.union(delivery.manifest(docs, sums).select(F.col("doc_id").alias("l_orderkey"), F.lit("manifest"), F.lit(1).cast("long")))


@query("select c_nationkey run, c_custkey as item from customer qualify row_number() over (partition by c_nationkey order by c_custkey desc) <= 2")
def snk13_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import ranking

    return ranking.by_tiers(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.lit(True)], [F.col("c_custkey").desc()], 2).select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("item"))


@query("with e as (select l_orderkey, l_partkey from lineitem where l_returnflag <> 'R'), a as (select l_orderkey, l_partkey from lineitem where l_returnflag <> 'A'), d as ((select *, 'missing' as kind from (select * from e except all select * from a)) union all (select *, 'extra' from (select * from a except all select * from e))) select l_orderkey, kind, count(*) n from d group by 1, 2")
def snk16_failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    e, a = x.where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey"), x.where("l_returnflag <> 'A'").select("l_orderkey", "l_partkey")
    both = e.exceptAll(a).withColumn("kind", F.lit("missing")).union(a.exceptAll(e).withColumn("kind", F.lit("extra")))
    return both.groupBy("l_orderkey", "kind").agg(F.count("*").alias("n"))


@query("select s_suppkey, '{\"name\":\"' || s_name || '\",\"status\":\"approved\"}' as mirror from supplier where s_suppkey % 2 = 0")
def snk17_model_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import payloads

    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_name").alias("name"), F.lit("approved").alias("status"))
    return s.select("s_suppkey", payloads.canonical(["name", "status"]).alias("mirror"))


@query("select n_nationkey, case when n_nationkey % 4 = 0 then 'done' else 'running' end status, n_name as note from nation")
def snk21_status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import joins

    base = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("running").alias("status"), F.col("n_name").alias("note"))
    return joins.overridden(base, base.where("n_nationkey % 4 = 0").select("n_nationkey", F.lit("done").alias("status"), F.lit(None).cast("string").alias("note")), ["n_nationkey"], ["status", "note"])


@query("select o_orderkey, c_name as name from orders left join customer on c_custkey = o_custkey where o_orderstatus = 'P' qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1")
def src20_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest package of each owner, with the owner's record."""
    from .operators import ranking

    o = ranking.extreme(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), ["o_custkey"], [F.col("o_orderkey").desc()])
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return o.join(c, "o_custkey", "left").select("o_orderkey", "name")


@query("select e.event_type, count(*) n from events e where event_id % 2 = 0 group by 1 having count(*) > 0")
def stm12_other_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = store.updated_where(table(spark, sf_dir, "events"), F.col("event_id") % 2 == 1, {"event_type": F.lit(None)})
    return left.where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select count(*) done, max(event_id) last_id, round(100.0 * count(*) filter (event_type <> 'error') / count(*), 1) ok_pct from events")
def stm11_scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.count_if(F.col("event_type") != "error")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("done"), F.max("event_id").alias("last_id"), F.round(F.lit(100.0) * ok / F.count("*"), 1).alias("ok_pct"))


@query("select l_orderkey, cast(sum(l_quantity) as bigint) quantity from lineitem group by 1")
def flt30_pruned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the two columns that the output needs are read."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("quantity"))


@query("select user_id, sha256('s' || user_id) digest from (select distinct user_id from events where user_id is not null)")
def hsh04_session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").where("user_id is not null").distinct()
    return users.select("user_id", F.sha2(F.concat(F.lit("s"), "user_id"), 256).alias("digest"))


@query(f"with {ROWS_SQL} select doc_id, i, cast(10 * (i * 12 // 10) as double) y, x, case x when 10 then flag when 120 then part else cast(price as varchar) end as text from r, (values (10.0::double), (120.0::double), (310.0::double)) c(x) where page <= 30")
def src05_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of a document's first thirty pages, their places snapped to ten units."""
    from .sources import words

    cells = rows(spark, sf_dir).where("page <= 30").select("doc_id", "i", F.explode("cells").alias("c")).select("doc_id", "i", F.col("c.text").alias("text"), F.col("c.x0").alias("x0"), (F.col("i") * 12.0).alias("y0"))
    return cells.select("doc_id", "i", words.snapped(F.col("y0")).alias("y"), words.snapped(F.col("x0")).alias("x"), "text")


@query("select c_custkey, c_name as \"Name\", cast(null as varchar) as \"Total\", c_mktsegment as \"Segment\" from customer")
def src11_blueprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet whose first row that is not blank is its header, by which its columns are put in order."""
    from .sources import payloads

    c = table(spark, sf_dir, "customer")
    body = c.select((F.col("c_custkey") + 10).alias("n"), F.col("c_custkey").cast("string").alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_name").alias("c"))
    top = spark.createDataFrame([(0, " ", None, ""), (1, "Key", " SEGMENT", "name ")], "n long, a string, b string, c string")
    found = payloads.by_header(top.union(body), "n", ["a", "b", "c"], ["Key", "Name", "Total", "Segment"])
    return found.withColumn("c_custkey", F.col("Key").cast("long")).drop("Key")
