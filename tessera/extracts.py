"""Queries of extracted rows, gates and inferred formats over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ITEMS_SQL, LINES_SQL, line_items, text_lines
from .operators import extracts as x
from .operators import finance, sequences
from .registry import money, query, table

MONEY = "decimal(18,2)"


@query(f"""with {ITEMS_SQL} select doc_id, count(*) n, array_to_string(list_sort(list(l_linenumber)), ',') lines from items where charge_type not in ('tax', 'fee', 'surcharge') and service_id is null group by 1""")
def flt11_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    has_id = F.coalesce(F.col("service_id").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    bare = line_items(spark, sf_dir).where(~F.col("charge_type").isin("tax", "fee", "surcharge") & ~has_id)
    numbers = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: n.cast("string"))
    return bare.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(numbers, ",").alias("lines"))


@query("select c_custkey, c_mktsegment from customer where coalesce(lower(trim(c_mktsegment)), '') not in ('building', 'machinery')")
def flt14_label_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("building ",), ("MACHINERY",)], "label string").select(F.lower(F.trim("label")).alias("_label"))
    rows = table(spark, sf_dir, "customer").withColumn("_label", F.lower(F.trim("c_mktsegment")))
    return rows.join(labels, "_label", "left_anti").select("c_custkey", "c_mktsegment")


@query(f"""select doc_id, count(*) filter (length(trim(line)) between 3 and 60 and regexp_matches(line, '[A-Za-z]')) labels, count(*) n from ({LINES_SQL}) group by 1""")
def flt25_label_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(x.label_like(F.col("line"))).alias("labels"), F.count("*").alias("n"))


@query(f"""select doc_id, count(*) kept from (select doc_id, trim(line) l from ({LINES_SQL})) where not (l like '%.' or l like '%?' or contains(l, '@') or (len(regexp_split_to_array(l, ' +')) > 4 and not contains(l, ':'))) group by 1""")
def flt18_span_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).where(~x.sentence_like(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("""select conv_id, turn from (select conv_id, turn, sum(length(text)) over w s, row_number() over w n from conversations window w as (partition by conv_id order by turn rows unbounded preceding)) where s <= 400 or n = 1""")
def flt29_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text"), 400).select("conv_id", "turn")


@query("""select o_orderkey, case when o_orderkey % 9 >= 6 and o_custkey % 3 = 0 then 'large and unreconciled' end blocker from orders""")
def flt28_large_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and results are made up from keys; a document that was not scored passes."""
    ok = F.when(F.col("o_custkey") % 3 == 0, False).when(F.col("o_custkey") % 3 == 1, True)
    blocked = (F.col("o_orderkey") % 9 >= 6) & (ok == False)  # noqa: E712
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(blocked, "large and unreconciled").alias("blocker"))


@query("""with o as (select lower(replace(p_brand, ' ', '')) k, p_name from part where p_size > 45 and p_name is not null qualify row_number() over (partition by lower(replace(p_brand, ' ', '')) order by p_partkey) = 1)
select p_partkey, coalesce(o.p_name, p.p_name) p_name from part p left join o on lower(replace(p_brand, ' ', '')) = k""")
def jn07_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    return x.overlaid(parts, parts.where("p_size > 45"), "p_brand", "p_name", "p_partkey").select("p_partkey", "p_name")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) calls, cast(sum(cast(value as decimal(18,2))) as decimal(18,2)) cost from events group by 1")
def agg09_cost_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.sum(money("value")).cast(MONEY).alias("cost"))


@query("select c_custkey, coalesce(max(o_orderkey), 0) version from customer left join orders on c_custkey = o_custkey and o_totalprice > 100000 group by 1")
def agg23_max_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("v"))
    return table(spark, sf_dir, "customer").join(top, "c_custkey", "left").select("c_custkey", F.coalesce("v", F.lit(0)).cast("long").alias("version"))


@query(r"""with v as (select o_custkey, case when o_orderkey % 50 = 0 then 'A' || o_orderkey else cast(o_orderkey as varchar) end v from orders)
select o_custkey, case when bool_and(regexp_matches(v, '^\d+$')) then case when count(distinct length(v)) = 1 then '\d{' || max(length(v)) || '}' else '\d+' end end pattern from v group by 1""")
def agg25_identifier_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("A"), key)).otherwise(key).alias("v"))
    return x.identifier_patterns(rows, ["o_custkey"], "v")


@query("""with d as (select o_custkey, o_orderkey, o_custkey % 2 = 0 e, day(o_orderdate) k from orders) select o_custkey, case when e then 'd/M/yyyy' else 'M/d/yyyy' end format from d where k > 12 group by o_custkey, e""")
def agg26_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("due "), printed).alias("printed"))
    return x.date_formats(rows, ["o_custkey"], "printed", "o_orderkey")


@query("select p_brand, count(*) attempts, count(*) filter (p_size > 25) successes, round(count(*) filter (p_size > 25) / count(*), 4) rate from part group by 1")
def agg37_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.count_if(F.col("p_size") > 25)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("attempts"), good.alias("successes"), F.round(F.try_divide(good, F.count("*")), 4).alias("rate"))


@query("""with e as (select user_id, event_id, epoch_us(ts) // 3600000000 as hour, row_number() over (partition by user_id order by event_id) n from events)
select user_id, event_id, max(hour - n) over (partition by user_id order by event_id rows unbounded preceding) + n steady from e""")
def win26_steady_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole hours, so that rows of one hour meet."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("at"))
    return x.steady_clock(rows, ["user_id"], "event_id", "at", "steady").select("user_id", "event_id", "steady")


@query("""with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) n from conversations where length(text) % 4 = 0)
select conv_id, max(turn) filter (n = 1) as first, max(turn) filter (n = 2) as second from r group by 1""")
def win24_first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.first_two(table(spark, sf_dir, "conversations").where(F.length("text") % 4 == 0), ["conv_id"], "turn", "turn")


@query("""with g as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) b from conversations)
select conv_id, cast(b as bigint) block, string_agg(text, ' ' order by turn) as text from g where b > 0 group by 1, 2""")
def win08_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = sequences.transition_groups(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda r: r["t"])
    return grouped.groupBy("conv_id", F.col("group").alias("block")).agg(F.array_join(parts, " ").alias("text"))


@query("select 'flag' as field, lower(l_returnflag) as value, count(*) n from lineitem group by 2 union all select 'status', lower(l_linestatus), count(*) from lineitem group by 2")
def set08_expected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "lineitem").select(F.lower("l_returnflag").alias("flag"), F.lower("l_linestatus").alias("status")).unpivot([], ["flag", "status"], "field", "value")
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


@query(r"select c_custkey, nullif(regexp_extract(c_name, '#0*(\d+)$', 1), '') as captured, nullif(regexp_extract(c_name, '^[A-Za-z]+', 0), '') as whole from customer")
def str03_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", x.captured(F.col("c_name"), r"#0*(\d+)$").alias("captured"), x.captured(F.col("c_name"), "^[A-Za-z]+").alias("whole"))


@query(r"select l_orderkey, l_linenumber, l_partkey, regexp_replace(cast(cast(l_tax as decimal(10,4)) as varchar), '\.?0+$', '') rate from lineitem")
def num18_rate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.rate_text(F.col("l_tax")).alias("rate"))


@query("select doc_id, sha256(text) digest from documents")
def hsh03_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""with {ITEMS_SQL}, s as (select doc_id, sum(amount) computed from items group by 1)
select o_orderkey doc_id, abs(cast(coalesce(computed, 0) - cast(o_totalprice as decimal(18,2)) as double)) / abs(o_totalprice) <= 0.005 verified from orders left join s on o_orderkey = doc_id""")
def rec04_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without a stated total is not verified."""
    nothing = F.lit(None).cast(MONEY)
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), money("o_totalprice").alias("total_due"), *[nothing.alias(c) for c in ("subtotal", "tax", "fees", "current_charges", "excluded_total")])
    done = finance.reconciled(docs, finance.charge_sums(line_items(spark, sf_dir)), threshold=0.005)
    return done.select("doc_id", (F.col("status") == "reconciled").alias("verified"))
