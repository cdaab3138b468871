"""The registry of queries over the test tables, and SQL that gives the same rows.

Orders stand for documents with stated totals, lineitem for their lines, events for logs, conversations
for rows with roles, texts of documents for pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import amounts, dates, text
from .operators import diff, finance, joins, sequences, warehouse
from .plans import expressions, output, rules
from .registry import money, query, table

MONEY = "decimal(18,2)"
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINE_SQL = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as documents have them: returned ones are tax, of the others every seventh part is a fee."""
    kind = F.when(F.col("l_returnflag") == "R", "tax").when(F.col("l_partkey") % 7 == 0, "fee").otherwise("recurring")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), *LINE_ORDER, "l_returnflag", kind.alias("charge_type"), money("l_extendedprice").alias("amount"), F.lit(None).cast(MONEY).alias("tax_amount"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey").cast("string")).alias("service_id"))


ITEMS_SQL = f"items as (select l_orderkey doc_id, {LINE_SQL}, case when l_returnflag = 'R' then 'tax' when l_partkey % 7 = 0 then 'fee' else 'recurring' end charge_type, cast(l_extendedprice as decimal(18,2)) amount, case when l_suppkey % 3 <> 0 then cast(l_suppkey as varchar) end service_id from lineitem)"


@query(f"""
with {ITEMS_SQL},
s as (select doc_id, sum(case when charge_type = 'recurring' then amount else 0 end) net, sum(case when charge_type = 'tax' then amount else 0 end) tax, sum(case when charge_type = 'fee' then amount else 0 end) fee from items group by 1),
d as (select o_orderkey doc_id, cast(o_totalprice as decimal(18,2)) target, coalesce(net, 0) + coalesce(tax, 0) + coalesce(fee, 0) computed from orders left join s on o_orderkey = doc_id),
v as (select *, case when target = 0 then 0 else computed - target end variance, case when target = 0 then 0 else abs(cast(computed - target as double)) / abs(cast(target as double)) end pct from d)
select doc_id, cast(computed as decimal(18,2)) computed_total, target, cast(variance as decimal(18,2)) variance, round(pct, 6) variance_pct, case when pct <= 0.01 then 'reconciled' else 'mismatch' end status from v""")
def rec01_reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast(MONEY)
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), money("o_totalprice").alias("total_due"), *[nothing.alias(c) for c in ("subtotal", "tax", "fees", "current_charges", "excluded_total")])
    done = finance.reconciled(docs, finance.charge_sums(line_items(spark, sf_dir)))
    return done.select("doc_id", "computed_total", "target", "variance", F.round("variance_pct", 6).alias("variance_pct"), "status")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec01_reconcile_orders(spark, sf_dir)


@query(f"""
with {ITEMS_SQL} select doc_id, cast(sum(case when charge_type = 'recurring' then amount else 0 end) as decimal(18,2)) net, cast(sum(case when charge_type = 'tax' then amount else 0 end) as decimal(18,2)) tax_rows,
cast(sum(case when charge_type = 'fee' then amount else 0 end) as decimal(18,2)) fee_rows, count(*) n_rows from items group by 1""")
def agg01_charge_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.charge_sums(line_items(spark, sf_dir)).drop("line_tax")


FILL_SQL = "l as (select l_orderkey doc_id, " + LINE_SQL + ", cast(l_extendedprice as decimal(18,2)) amount, case when l_linenumber % 2 = 1 then cast(round(cast(l_extendedprice as decimal(18,2)) * (case when l_orderkey % 2 = 0 then 0.08 else 0.05 end), 2) as decimal(18,2)) end tax_amount from lineitem)"


@query(f"""
with {FILL_SQL},
f as (select doc_id, bool_and(tax_amount is null or abs(tax_amount - round(amount * 0.08, 2)) <= 0.01) and count(tax_amount) > 0 fits from l group by 1)
select doc_id, l_linenumber, l_partkey, l_suppkey, amount, cast(case when tax_amount is null and fits then round(amount * 0.08, 2) else tax_amount end as decimal(18,2)) tax_filled from l join f using (doc_id)""")
def rec03_rate_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_items(spark, sf_dir).drop("tax_amount")
    rate = F.when(F.col("doc_id") % 2 == 0, F.lit("0.08")).otherwise(F.lit("0.05")).cast("decimal(4,2)")
    lines = lines.withColumn("tax_amount", F.when(F.col("l_linenumber") % 2 == 1, F.round(F.col("amount") * rate, 2).cast(MONEY)))
    rates = lines.select("doc_id").distinct().withColumn("rate", F.lit("0.08").cast("decimal(4,2)"))
    return finance.rate_filled(lines, rates).select("doc_id", "l_linenumber", "l_partkey", "l_suppkey", "amount", "tax_filled")


@query(f"""
with l as (select l_orderkey, {LINE_SQL}, cast(round(l_extendedprice * 100) as bigint) cents, cast(1000 + l_orderkey % 997 as bigint) tax_cents from lineitem),
w as (select *, sum(cents) over (partition by l_orderkey order by {LINE_SQL} rows unbounded preceding) c, sum(cents) over (partition by l_orderkey) s from l),
a as (select *, cast((2 * tax_cents * c + s) // (2 * s) as bigint) share from w)
select l_orderkey, {LINE_SQL.replace("l_extendedprice, ", "")}, cents, cast(share - coalesce(lag(share) over (partition by l_orderkey order by {LINE_SQL}), 0) as bigint) allocated from a""")
def win12_allocate_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), (F.col("l_orderkey") % 997 + 1000).alias("tax_cents"))
    return finance.allocated(lines, doc="l_orderkey", order=LINE_ORDER).drop("tax_cents", "l_extendedprice")


@query("""
with l as (select l_orderkey, sum(case when l_linenumber = 7 then 1 else 0 end) <> 0 has_some from lineitem group by 1)
select o_orderkey doc_id, case when coalesce(has_some, false) then 'per_line' when o_orderkey % 3 = 0 then 'allocated' when o_orderkey % 3 = 1 then 'rate' else 'none' end method from orders left join l on o_orderkey = l_orderkey""")
def num14_tax_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("o_orderkey") % 3
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(third == 0, 1).cast(MONEY).alias("tax"), F.when(third == 1, 0.2).alias("tax_rate"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") == 7, 1).cast(MONEY).alias("tax_amount"))
    return finance.tax_plan(docs, lines)


@query(f"""with {ITEMS_SQL} select doc_id, l_linenumber, l_partkey, charge_type, amount, service_id from items where charge_type = 'recurring' or (charge_type = 'fee' and service_id is not null)""")
def flt09_deliverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.deliverable(line_items(spark, sf_dir)).select("doc_id", "l_linenumber", "l_partkey", "charge_type", "amount", "service_id")


@query(f"""with {ITEMS_SQL} select doc_id, l_partkey, l_suppkey, amount, row_number() over (partition by doc_id order by {LINE_SQL}) line_number from items where service_id is not null and amount <> 0""")
def flt10_resequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_items(spark, sf_dir).where("service_id is not null and amount <> 0")
    return finance.resequenced(kept, doc="doc_id", order=LINE_ORDER).select("doc_id", "l_partkey", "l_suppkey", "amount", "line_number")


# Two runs over one set of lines: what was expected, and a run that changed or lost some.
KEY = ["l_orderkey", "l_linenumber", "quantity"]
PAIR_SQL = "e as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) quantity from lineitem), a as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) + case when l_partkey % 10 = 0 then 1 else 0 end quantity from lineitem where l_suppkey % 11 <> 0)"


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, quantity = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    changed = quantity + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)
    return lines.select("l_orderkey", "l_linenumber", quantity.alias("quantity")), lines.where("l_suppkey % 11 <> 0").select("l_orderkey", "l_linenumber", changed.alias("quantity"))


@query(f"with {PAIR_SQL} select * from e except all select * from a")
def set01_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.missing(*_pair(spark, sf_dir), KEY)


@query(f"with {PAIR_SQL} select * from a except all select * from e")
def set01_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, actual = _pair(spark, sf_dir)
    return diff.missing(actual, expected, KEY)


@query(f"""with {PAIR_SQL}, m as (select count(*) n from (select * from e intersect all select * from a)), c as (select (select count(*) from e) expected, (select count(*) from a) actual, (select n from m) matched)
select expected, actual, matched, round(matched / actual, 4) "precision", round(matched / expected, 4) recall, round(2 * (matched / actual) * (matched / expected) / (matched / actual + matched / expected), 4) f1 from c""")
def agg17_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.scores(diff.counts(*_pair(spark, sf_dir), KEY))


CELLS_SQL = f"p as (select l_orderkey, {LINE_SQL}, l_returnflag, l_linestatus, row_number() over (partition by l_orderkey order by {LINE_SQL}) n from lineitem)"


@query(f"""with {CELLS_SQL}, c as (select 'returnflag' as column, l_returnflag e, case when l_partkey % 5 = 0 then 'X' else l_returnflag end a, struct_pack(k := l_orderkey, n := n) s from p
union all select 'linestatus', l_linestatus, case when l_suppkey % 4 = 0 then null else l_linestatus end, struct_pack(k := l_orderkey, n := n) from p)
select "column", count(*) n, arg_min(e, s) example from c where e is distinct from a group by 1""")
def agg16_cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = finance.resequenced(table(spark, sf_dir, "lineitem"), doc="l_orderkey", order=LINE_ORDER, name="n")
    pairs = lines.select("l_orderkey", "n", F.col("l_returnflag").alias("expected_returnflag"), F.when(F.col("l_partkey") % 5 == 0, "X").otherwise(F.col("l_returnflag")).alias("actual_returnflag"), F.col("l_linestatus").alias("expected_linestatus"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linestatus")).alias("actual_linestatus"))
    return diff.cell_summary(pairs, ["returnflag", "linestatus"], F.struct("l_orderkey", "n"))


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {LINE_SQL}) = 1")
def set02_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# Events as a log of calls: the value is the cost, the type the call's.
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("cost", money("value"))


@query("select event_type, count(*) calls, cast(sum(cast(value as decimal(18,2))) as decimal(18,2)) total_cost from events group by 1")
def agg05_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.cost_summary(costs(spark, sf_dir), ["event_type"])


@query("""select case when event_type = 'error' then 'training' when event_type = 'view' then 'classification' when c_mktsegment = 'BUILDING' then 'training' else 'production' end bucket, count(*) calls, cast(sum(cast(value as decimal(18,2))) as decimal(18,2)) total_cost
from events left join customer on user_id = c_custkey group by 1""")
def agg06_cost_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = costs(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    call = F.when(F.col("event_type") == "error", "training").when(F.col("event_type") == "view", "classification").otherwise(F.col("event_type"))
    source = F.when(F.col("c_mktsegment") == "BUILDING", "training").otherwise(F.col("c_mktsegment"))
    return warehouse.cost_summary(joined.withColumn("bucket", warehouse.bucket(call, source)), ["bucket"])


@query("""select count(*) total, count(*) filter (o_orderstatus = 'F') completed, count(*) filter (o_orderstatus = 'O') failed, round(100.0 * count(*) filter (o_orderstatus = 'F') / count(*), 1) completion_pct,
round(100.0 * count(*) filter (o_totalprice > 100000 and o_orderkey % 4 <> 0) / count(*) filter (o_orderkey % 4 <> 0), 1) reconciled_pct from orders""")
def agg07_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed_with_warnings").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    jobs = table(spark, sf_dir, "orders").select(status.alias("status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") > 100000).alias("ok"))
    return warehouse.stats(jobs, "status", "ok")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) n from events group by 1")
def agg08_volume_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.by_day(table(spark, sf_dir, "events"), "ts").withColumn("day", F.col("day").cast("string"))


@query("""with m as (select cast(date_trunc('month', ts) as date) as month, count(*) n, sum(cast(value as decimal(18,2))) total from events where event_type = 'error' group by 1),
s as (select cast(unnest(generate_series((select min(month) from m), (select max(month) from m), interval 1 month)) as date) as month) select strftime(month, '%Y-%m-%d') as month, coalesce(n, 0) n, cast(coalesce(total, 0) as decimal(18,2)) total from s left join m using (month)""")
def agg11_month_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.by_month_filled(costs(spark, sf_dir).where("event_type = 'error'"), "ts", "cost").withColumn("month", F.col("month").cast("string"))


@query("""select c_mktsegment segment, count(*) calls, cast(sum(cast(value as decimal(18,2))) as decimal(18,2)) total_cost from events left join customer on user_id = c_custkey and c_custkey % 2 = 0 group by 1""")
def agg13_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return warehouse.cost_summary(costs(spark, sf_dir).join(known, "user_id", "left"), ["segment"])


@query("select o_orderstatus, count(*) n from orders where o_totalprice > 50000 and o_orderpriority like '%URGENT%' group by 1")
def agg14_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"o_orderstatus": F.col("o_orderstatus") == "F", "price": F.col("o_totalprice") > 50000, "priority": F.col("o_orderpriority").contains("URGENT")}
    return warehouse.facets(table(spark, sf_dir, "orders"), filters, "o_orderstatus")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def jn02_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""select c_custkey, o_orderkey from customer left join (select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on c_custkey = o_custkey""")
def jn03_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = joins.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return table(spark, sf_dir, "customer").join(last.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left").select("c_custkey", "o_orderkey")


@query("""select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) in_force from events""")
def jn05_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return sequences.carried(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], declared, "in_force").select("user_id", "event_id", "in_force")


@query("""with e as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) era from events)
select user_id, event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id, era order by ts, event_id rows unbounded preceding) context from e""")
def win11_row_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return sequences.carried(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], anchor, "context", reset=F.col("event_type") == "error").select("user_id", "event_id", "context")


@query(f"""with j as (select o_orderkey, l_linenumber, l_partkey, {LINE_SQL.split(", ", 2)[2]}, case when l_suppkey = o_custkey % 100 then 1 when l_quantity > 45 then 2 when l_returnflag = 'R' then 3 when l_orderkey is not null then 4 end tier from orders left join lineitem on o_orderkey = l_orderkey)
select o_orderkey, cast(tier as bigint) tier, l_linenumber, l_partkey from j qualify row_number() over (partition by o_orderkey order by tier nulls last, {LINE_SQL}) = 1""")
def jn06_tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    tiers = [F.col("l_suppkey") == F.col("o_custkey") % 100, F.col("l_quantity") > 45, F.col("l_returnflag") == "R", F.col("l_orderkey").isNotNull()]
    best = joins.best_match(table(spark, sf_dir, "orders"), lines, ["o_orderkey"], tiers, ["o_orderkey"], [F.col(c) for c in LINE_ORDER])
    return best.select("o_orderkey", F.col("tier").cast("long").alias("tier"), "l_linenumber", "l_partkey")


@query("""select p_partkey, case when p_retailprice >= 900 and p_retailprice < 1000 then 'low' when p_retailprice >= 1000 and p_retailprice < 1500 then 'mid' when p_retailprice >= 1500 and p_retailprice < 2500 then 'high' end band from part""")
def jn13_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(900.0, 1000.0, "low"), (1000.0, 1500.0, "mid"), (1500.0, 2500.0, "high")], "lo double, hi double, band string")
    return joins.banded(table(spark, sf_dir, "part"), "p_retailprice", bands).select("p_partkey", "band")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 10)")
def jn14_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(found, "o_orderkey", "left_anti").select("o_orderkey")


@query("""with b as (select o_orderkey k, case when o_orderkey % 7 <> 0 then o_orderkey % 5 end s from orders where o_orderkey % 3 <> 0), a as (select o_orderkey k, o_orderkey % 4 s from orders where o_orderkey % 2 <> 0)
select coalesce(b.k, a.k) case_id, b.s before, a.s after, case when b.k is null then 'new' when a.k is null then 'missing' when a.s - b.s is null then 'unscored' when a.s < b.s then 'regressed' when a.s > b.s then 'improved' else 'unchanged' end outcome from b full join a on b.k = a.k""")
def jn16_full_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    before = cases.where("case_id % 3 <> 0").withColumn("score", F.when(F.col("case_id") % 7 != 0, F.col("case_id") % 5))
    return joins.run_compare(before, cases.where("case_id % 2 <> 0").withColumn("score", F.col("case_id") % 4), ["case_id"], "score")


@query("""select p_brand place, count(distinct case when p_size > 48 then p_type end) n_owners, case count(distinct case when p_size > 48 then p_type end) when 0 then 'unmapped' when 1 then 'mapped' else 'conflict' end state from part group by 1""")
def jn17_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("place"), F.when(F.col("p_size") > 48, F.col("p_type")).alias("owner"))
    return joins.owners(parts, "place", "owner")


@query(r"""select item_id, doc_id from benchmark b join documents d on contains(regexp_replace(lower(d.text), '[\s,\-]+', '', 'g'), regexp_replace(lower(b.text), '[\s,\-]+', '', 'g'))""")
def jn19_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return joins.contained(items, table(spark, sf_dir, "documents").select("doc_id", "text"), needle="passage", text="text", needle_key="item_id", text_key="doc_id")


def marks() -> tuple[Column, Column]:
    return F.col("role") == "user", F.col("role") == "assistant"


@query("""with c as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) span from conversations),
e as (select *, coalesce(sum(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id, span order by turn rows between unbounded preceding and 1 preceding), 0) ends from c where span > 0)
select conv_id, turn, cast(span as bigint) span from e where ends = 0""")
def win03_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.spans(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], *marks()).select("conv_id", "turn", "span")


@query("""select conv_id, turn, cast(g as bigint) as "group" from (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) g from conversations) where g > 0""")
def win04_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.transition_groups(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], marks()[0]).select("conv_id", "turn", "group")


@query("""with recursive t as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) n, length(text) % 3 = 0 tog from conversations),
s as (select conv_id, n, turn, role, tog, 0 inside, case when tog or role = 'user' then 1 else 0 end nxt from t where n = 1
union all select t.conv_id, t.n, t.turn, t.role, t.tog, s.nxt, case when s.nxt = 0 then case when t.tog or t.role = 'user' then 1 else 0 end else case when t.tog or t.role = 'assistant' then 0 else 1 end end from s join t on t.conv_id = s.conv_id and t.n = s.n + 1)
select conv_id, turn from s where inside = 1 and not (tog or role = 'assistant')""")
def win02_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.length("text") % 3 == 0
    return rules.in_region(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], marks()[0] | both, marks()[1] | both).select("conv_id", "turn")


@query("""with d as (select distinct user_id, datediff('day', date '1970-01-01', cast(ts as date)) k from events), g as (select *, k - row_number() over (partition by user_id order by k) b from d)
select user_id, min(k) as first, max(k) as last, count(*) n from g group by user_id, b""")
def win14_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("k"))
    return sequences.islands(days, ["user_id"], "k")


@query("""with t as (select user_id, event_id, ts, extract(epoch from ts) s from events), n as (select *, case when s - lag(s) over (partition by user_id order by s, event_id) > 86400 then 1 else 0 end b from t)
select user_id, event_id, cast(sum(b) over (partition by user_id order by s, event_id rows unbounded preceding) + 1 as bigint) cluster from n""")
def win16_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return sequences.gap_clusters(rows, ["user_id"], "s", 86400, ties=["event_id"]).select("user_id", "event_id", "cluster")


@query("""select conv_id, turn, case when row_number() over (partition by conv_id order by turn) <= greatest(1, count(*) over (partition by conv_id) // 2) then 'a' else 'b' end half from conversations""")
def win18_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.halves(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "half")


@query("select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey desc limit 25 offset 50")
def srt01_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.page(table(spark, sf_dir, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3, 25).select("o_orderkey", "o_custkey")


@query("""with p as (select *, row_number() over (partition by p_brand order by p_partkey) turn, min(p_partkey) over (partition by p_brand) f from part) select p_partkey, p_brand, turn from p order by turn, f limit 40""")
def srt08_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.representatives(table(spark, sf_dir, "part"), F.col("p_brand"), ["p_partkey"], 40).select("p_partkey", "p_brand", F.col("turn").cast("long").alias("turn"))


@query("select distinct c_mktsegment from customer where trim(c_mktsegment) <> ''")
def srt17_facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(text.blank_to_null(F.col("c_mktsegment")).isNotNull()).select("c_mktsegment").distinct()




@query(r"""select doc_id, len(m) n, cast(list_sum(list_transform(m, lambda x: cast(replace(x, ',', '') as decimal(18,2)))) as decimal(18,2)) total from (select doc_id, regexp_extract_all(text, '(-?\d[\d,]*\.\d\d)', 1) m from documents) where len(m) > 0""")
def num06_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", amounts.money_tokens(F.col("text")).alias("m")).where(F.size("m") > 0)
    return found.select("doc_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0).cast(MONEY), lambda a, x: (a + x).cast(MONEY)).alias("total"))


@query("""select o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as start, strftime(last_day(cast(o_orderdate as date)), '%Y-%m-%d') as "end", strftime(o_orderdate, '%m/%d/%Y') delivered from orders""")
def dat06_month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.month_start(day).cast("string").alias("start"), dates.month_end(day).cast("string").alias("end"), dates.delivered(day).alias("delivered"))



@query("select s_suppkey, regexp_replace(s_name, '[^0-9]', '', 'g') digits, upper(trim(s_name)) shout from supplier")
def str06_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.transformed(F.col("s_name"), ["digits_only"]).alias("digits"), text.transformed(F.col("s_name"), ["trim", "uppercase"]).alias("shout"))


@query("""select event_id, trim(split_part(split_part(props, ':', 2), '}', 1), ' :') as value from events""")
def str02_after_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.after_label(F.col("props"), '"k"', ["}"]).alias("value"))



@query("""select l_orderkey, l_linenumber, l_partkey, cast(cast(l_quantity as decimal(18,6)) * cast(l_discount as decimal(18,6)) as decimal(18,6)) product, cast(abs(cast(l_quantity as decimal(18,6)) - 25) as decimal(18,6)) distance, case when l_returnflag = 'R' then l_linestatus else l_returnflag end flag from lineitem""")
def exp01_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda n: {"op": "field", "name": n}
    lines = table(spark, sf_dir, "lineitem").withColumn("first_flag", F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")))
    plan = {"product": {"op": "multiply", "args": [field("l_quantity"), field("l_discount")]}, "distance": {"op": "abs", "args": [{"op": "subtract", "args": [field("l_quantity"), {"op": "literal", "value": 25}]}]}, "flag": {"op": "coalesce", "args": [field("first_flag"), field("l_linestatus")]}}
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", *[expressions.plan_expression(t).alias(n) for n, t in plan.items()])


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, cast(case when l_suppkey % 2 = 0 then l_quantity end as decimal(18,6)) a, cast(case when l_partkey % 3 = 0 then l_linenumber end as decimal(18,6)) b from lineitem)
select l_orderkey, l_linenumber, l_partkey, coalesce(a, b) extracted, cast(case when a is null and b is null then null else coalesce(a, 0) + coalesce(b, 0) end as decimal(18,6)) summed, cast(a - coalesce(b, 0) as decimal(18,6)) less, cast(a * b as decimal(18,6)) product from l""")
def exp05_value_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = [F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity")), F.when(F.col("l_partkey") % 3 == 0, F.col("l_linenumber"))]
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", *[expressions.value_expression(op, parts).alias(n) for op, n in (("extract", "extracted"), ("sum", "summed"), ("subtract", "less"), ("product", "product"))])


@query("""select upper(trim(c_name)) as "Name", coalesce(case when c_custkey % 2 = 0 then c_mktsegment end, c_name) as "Segment" from customer""")
def exp14_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return output.project(rows, [output.OutputColumn("Name", "c_name", transforms=("trim", "uppercase")), output.OutputColumn("Segment", "segment", "c_name")])


LINES_SQL = "select doc_id, cast(generate_subscripts(x, 1) - 1 as bigint) n, unnest(x) line from (select doc_id, string_split(text, chr(10)) x from documents)"


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


@query(rf"""select doc_id, role, count(*) n from (select doc_id, case when regexp_matches(line, '(?i)licen[cs]ed?\b') then 'license' when regexp_matches(line, '\d{{3}}') then 'number' when length(line) >= 400 and not regexp_matches(line, '(?i)the') then 'foreign' else 'detail' end as role from ({LINES_SQL})) group by 1, 2""")
def flt05_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    classifiers = [("license", {"row_text": r"licen[cs]ed?\b"}), ("broken", {"row_text": "("}), ("number", {"row_text": r"\d{3}"}), ("foreign", {"min_length": 400, "exclude": "the"})]
    return text_lines(spark, sf_dir).withColumn("role", rules.classified(classifiers, F.col("line"))).groupBy("doc_id", "role").agg(F.count("*").alias("n"))


