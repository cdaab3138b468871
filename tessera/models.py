"""Queries of rule models, plans, groups and deliveries.

Lines of an order stand for the rows of a document: a flag, a part and a price in three columns of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as t
from .functions.binding import once
from .operators import delivery, grouping, joins
from .plans import executor, interpreter
from .plans.interpreter import Model, Region, Rule, Source
from .registry import money, query, table

ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
COLUMNS = {"flag": (0.0, 60.0), "part": (100.0, 200.0), "price": (300.0, 400.0)}
ROWS_SQL = f"r as (select *, flag || ' ' || part || ' ' || cast(price as varchar) as text, i // 3 + 1 page from (select l_orderkey doc_id, row_number() over (partition by l_orderkey order by {ORDER}) - 1 i, l_returnflag flag, 'P' || l_partkey part, cast(l_extendedprice as decimal(18,2)) price, l_linenumber ln, l_partkey from lineitem))"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key has its last name before lines are numbered, so that all windows over documents read one exchange
    lines = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    w = Window.partitionBy("doc_id").orderBy(*ORDER.split(", "))
    lines = lines.select("doc_id", (F.row_number().over(w) - 1).alias("i"), F.col("l_returnflag").alias("flag"), F.concat(F.lit("P"), "l_partkey").alias("part"), money("l_extendedprice").alias("price"), F.col("l_linenumber").alias("ln"), "l_partkey")
    cell = lambda c, x: F.struct(F.col(c).cast("string").alias("text"), F.lit(x).alias("x0"), F.lit(x + 40.0).alias("x1"))
    cells = F.array(cell("flag", 10.0), cell("part", 120.0), cell("price", 310.0))
    return lines.withColumns({"page": F.expr("cast(i div 3 + 1 as int)"), "row_index": F.col("i"), "text": F.concat_ws(" ", "flag", "part", F.col("price").cast("string")), "cells": cells})


def flag(value: str):
    return F.col("flag") == value


BEFORE = "over (partition by doc_id order by i rows between unbounded preceding and 1 preceding)"
SO_FAR = "over (partition by doc_id order by i rows unbounded preceding)"


@query(f"with {ROWS_SQL} select doc_id, i from (select *, last_value(case flag when 'A' then 1 when 'R' then 0 end ignore nulls) {BEFORE} s from r) where s = 1 and flag = 'N'")
def flt01_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpreter.locate(rows(spark, sf_dir), Region(start=("A P",), end=("R p",))).select("doc_id", "i")


@query(f"with {ROWS_SQL} select doc_id, i from (select *, coalesce(sum(case when flag = 'R' then 1 else 0 end) {BEFORE}, 0) ended from r) where ended = 0 and flag <> 'R'")
def flt01_region_without_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpreter.locate(rows(spark, sf_dir), Region(end=("R P",))).select("doc_id", "i")


@query(f"with {ROWS_SQL}, s as (select *, coalesce(max(case when flag = 'A' then i end) {BEFORE}, -1) last_a, coalesce(max(case when flag = 'R' then i end) {BEFORE}, -1) last_r, coalesce(min(case when flag = 'R' then i end) {BEFORE}, 99) first_r from r) select doc_id, i from s where (flag = 'A') or (last_a >= 0 and last_a > last_r and flag = 'N')")
def flt02_plan_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.plan_region(rows(spark, sf_dir), ["doc_id"], ["i"], "page", flag("A"), flag("R"), include_start=True).select("doc_id", "i")


@query(f"with {ROWS_SQL}, s as (select *, coalesce(max(case when flag = 'A' then i end) {BEFORE}, -1) last_a, coalesce(max(case when flag = 'R' then i end) {BEFORE}, -1) last_r from r) select doc_id, i from s where flag = 'A' or (last_a > last_r and (flag = 'N' or (flag = 'R' and l_partkey % 2 = 0)))")
def flt03_detail_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start rows stay, end rows only where they are totals, here those of even parts."""
    found = grouping.plan_region(rows(spark, sf_dir), ["doc_id"], ["i"], "page", flag("A"), flag("R"), include_start=True, include_end=True)
    return found.where(~flag("R") | (F.col("l_partkey") % 2 == 0)).select("doc_id", "i")


@query(f"with {ROWS_SQL}, s as (select *, last_value(case flag when 'A' then 1 when 'R' then 0 end ignore nulls) {BEFORE} s from r) select distinct doc_id, cast(page as integer) as page from s where s = 1 and flag = 'N'")
def flt04_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.region_pages(interpreter.locate(rows(spark, sf_dir), Region(start=("A P",), end=("R P",))), "doc_id", "page")


@query(f"with {ROWS_SQL} select doc_id, i from r where part like 'P1%' and price is not null and flag in ('A', 'N') and regexp_matches(text, '[02468]$')")
def flt06_row_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"min_cells": 3, "row_text": r"^[an] ", "column": "part", "pattern": "^P1", "has_amount_in_column": "price"}
    found = rows(spark, sf_dir).where(interpreter.row_matches(where, F.col("text"), F.col("cells"), COLUMNS))
    return found.where(interpreter.row_matches({"pattern": "[02468]$"}, F.col("text"), F.col("cells"), COLUMNS)).select("doc_id", "i")


@query(f"with {ROWS_SQL} select doc_id, i, part || ' ' || price as right_side, cast(null as varchar) as nothing from r")
def flt07_column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("doc_id", "i", interpreter.in_column(F.col("cells"), (100.0, 400.0)).alias("right_side"), interpreter.in_column(F.col("cells"), (500.0, 600.0)).alias("nothing"))


@query(f"with {ROWS_SQL} select doc_id, i from r where flag <> 'R' and l_partkey % 10 <> 7")
def flt08_row_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = executor.Plan(include=r"^[an] ", exclude=(r"P\d*7 ", "("))
    return executor.selected(rows(spark, sf_dir), plan).select("doc_id", "i")


@query(f"with {ROWS_SQL} select doc_id, i, cast(l_partkey as varchar) as value from r")
def flt13_value_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("doc_id", "i", t.captured(F.regexp_replace(F.concat("text", F.lit(" 20%")), r"\d+\s*%", ""), r"P(\d+)").alias("value"))


@query(f"with {ROWS_SQL} select doc_id, i, row_number() over (partition by doc_id order by i) grp from r where flag = 'R'")
def win05_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interpreter.grouped(rows(spark, sf_dir).withColumn("role", F.col("flag")), ("single", "R"))
    return found.select("doc_id", "i", F.col("group").alias("grp"))


@query(f"with {ROWS_SQL}, k as (select *, row_number() over (partition by doc_id order by i) n from r where l_partkey % 5 <> 0), c as (select *, coalesce(sum(case when flag = 'R' then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) era from k), o as (select *, max(case when flag = 'A' then 1 else 0 end) over (partition by doc_id, era order by i rows unbounded preceding) opened, max(case when flag = 'R' then 1 else 0 end) over (partition by doc_id, era) ends from c) select doc_id, i, dense_rank() over (partition by doc_id order by era) grp from o where opened = 1 and ends = 1")
def win06_total_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.total_groups(rows(spark, sf_dir), ["doc_id"], ["i"], flag("A"), flag("R"), F.col("l_partkey") % 5 == 0)
    return found.select("doc_id", "i", F.col("group").alias("grp"))


@query(f"with {ROWS_SQL}, g as (select *, sum(case when flag = 'A' then 1 else 0 end) {SO_FAR} grp from r), e as (select *, coalesce(max(case when flag = 'R' or (flag = 'A' and ln = 1) then 1 else 0 end) over (partition by doc_id, grp order by i rows between unbounded preceding and 1 preceding), 0) closed from g where grp > 0) select doc_id, i, cast(grp as bigint) grp from e where closed = 0")
def win07_marker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.marker_groups(rows(spark, sf_dir), ["doc_id"], ["i"], flag("A"), flag("R") | (flag("A") & (F.col("ln") == 1)))
    return found.select("doc_id", "i", F.col("group").alias("grp"))


@query(f"with {ROWS_SQL}, b as (select *, sum(case when flag = 'A' then 1 else 0 end) {SO_FAR} block from r), s as (select *, max(case when flag = 'A' then part end) over (partition by doc_id, block) service, coalesce(sum(case when flag = 'N' then 1 else 0 end) over (partition by doc_id, block order by i rows between unbounded preceding and 1 preceding), 0) since from b where block > 0), x as (select *, sum(case when flag = 'R' then price else 0 end) over (partition by doc_id, block, since order by i rows unbounded preceding) tax from s) select doc_id, i, service, cast(tax as decimal(18,2)) tax from x where flag = 'N'")
def win09_block_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.block_items(rows(spark, sf_dir), ["doc_id"], ["i"], F.when(flag("A"), F.col("part")), F.when(flag("R"), F.col("price")), flag("N"))
    return found.select("doc_id", "i", "service", "tax")


@query(f"with {ROWS_SQL}, s as (select *, coalesce(sum(case when flag = 'R' then 1 else 0 end) {BEFORE}, 0) since from r) select doc_id, max(i) filter (flag = 'R') i, string_agg(part, ' ' order by i) context from s where flag in ('N', 'R') group by doc_id, since having max(i) filter (flag = 'R') is not null")
def win10_charge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.with_context(rows(spark, sf_dir), ["doc_id"], ["i"], "part", flag("R"), flag("N")).select("doc_id", "i", "context")


@query(f"with {ROWS_SQL}, s as (select *, last_value(case when flag = 'A' then part end ignore nulls) {SO_FAR} ident from r) select doc_id, i, ident, price amount from s where ident is not null and l_partkey % 2 = 0")
def win21_charge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.charge_candidates(rows(spark, sf_dir), ["doc_id"], ["i"], F.when(flag("A"), F.col("part")), F.when(F.col("l_partkey") % 2 == 0, F.col("price")))
    return found.select("doc_id", "i", "ident", "amount")


@query(f"with {ROWS_SQL}, b as (select *, sum(case when flag = 'A' then 1 else 0 end) {SO_FAR} block, case when l_partkey % 3 > 0 then price end a from r), g as (select doc_id, block, max(case when flag = 'A' then part end) ident, min(case when flag = 'R' and a is not null then i end) t, max(case when a is not null then i end) l from b where block > 0 group by 1, 2) select g.doc_id, cast(g.block as bigint) block, ident, b.price amount, b.i as place from g join b on b.doc_id = g.doc_id and b.i = coalesce(t, l)")
def win22_marker_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.marker_candidates(rows(spark, sf_dir), ["doc_id"], "i", F.when(flag("A"), F.col("part")), flag("R"), F.when(F.col("l_partkey") % 3 > 0, F.col("price")))
    return found.withColumnRenamed("at", "place")


@query(f"with {ROWS_SQL}, s as (select *, last_value(case when flag = 'A' then part end ignore nulls) {SO_FAR} ident from r) select doc_id, string_agg(distinct ident, ',' order by ident) idents from s where ident is not null and ln <> 1 group by 1")
def win27_billable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.billable(rows(spark, sf_dir), ["doc_id"], ["i"], F.when(flag("A"), F.col("part")), F.when(F.col("ln") != 1, F.col("price")).otherwise(0))
    return found.select("doc_id", F.array_join("idents", ",").alias("idents"))


@query(f"with {ROWS_SQL}, s as (select *, coalesce(max(case when flag = 'N' then 1 else 0 end) {BEFORE}, 0) = 1 as inside from r), x as (select *, inside and flag = 'A' and ln % 2 = 0 item from s), y as (select *, coalesce(max(case when item then 1 else 0 end) {BEFORE}, 0) = 1 seen from x), z as (select *, max(case when seen and flag = 'R' then 1 else 0 end) {SO_FAR} = 1 done from y) select doc_id, i, price tax, cast(l_partkey as decimal(18,2)) amount from z where item and not done")
def win28_summary_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rows(spark, sf_dir).withColumn("values", F.when(F.col("ln") % 2 == 0, F.array("price", F.col("l_partkey").cast("decimal(18,2)"), F.lit(1).cast("decimal(18,2)"))).otherwise(F.array("price")))
    return grouping.summary_items(wide, ["doc_id"], ["i"], flag("N"), flag("A"), "values", flag("R")).select("doc_id", "i", "tax", "amount")


@query("select o_orderkey, n, 'AB' || (o_custkey + 10000) || case when n = 1 then 'X' else 'Y' end ident from orders, (values (1), (2)) v(n)")
def win20_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.concat(F.lit("AB"), F.col("o_custkey") + 10000)
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("head total "), ident, F.lit("X 1.00 rest Total "), ident, F.lit("Y end")).alias("text"))
    return grouping.segments(texts, "o_orderkey", "text", r"(?i)\btotal\s+([A-Z0-9][A-Z0-9\-/.]{4,})").select("o_orderkey", F.col("n").cast("int").alias("n"), "ident")


@query(f"with {ROWS_SQL}, k as (select distinct doc_id, part from r where flag = 'A') select r.doc_id, i, case when ln = 3 then 'no row' when flag <> 'N' and k.part is null then 'unknown identifier' else 'kept' end outcome from r left join k on k.doc_id = r.doc_id and k.part = case when flag <> 'N' then r.part end")
def flt15_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    named = r.withColumns({"row_ref": F.when(F.col("ln") != 3, F.col("i")), "ident": F.when(~flag("N"), F.col("part"))})
    return grouping.grounded(named, r.where(flag("A")).select("doc_id", F.col("part").alias("ident")), "doc_id", "row_ref", "ident").select("doc_id", "i", "outcome")


@query(f"with {ROWS_SQL}, e as (select *, coalesce(sum(case when flag = 'R' then 1 else 0 end) {BEFORE}, 0) era from r) select doc_id, i, last_value(case when flag = 'A' then part end ignore nulls) over (partition by doc_id, era order by i rows unbounded preceding) above from e")
def jn12_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.carried_with_barrier(rows(spark, sf_dir), ["doc_id"], ["i"], F.when(flag("A"), F.col("part")), flag("R"), "above").select("doc_id", "i", "above")


MODEL = Model(
    region=Region(columns=COLUMNS),
    classifiers=(("start", {"row_text": "^A "}), ("tax", {"row_text": "^R "})),
    grouping=("transition", "start"),
    fields={
        "service_id": Rule(Source("first", "part")),
        "amount": Rule(Source("detail", "price", last=True), kind="decimal"),
        "tax_amount": Rule(Source("tax", "price"), kind="decimal"),
        "gross": Rule(operation="sum", operands=("ref:amount", "ref:tax_amount", "const:1.50")),
        "charge_type": Rule(Source("last", "flag"), values={"r": "tax", "n": "usage"}, default="recurring"),
    },
)
GROUPS_SQL = f"{ROWS_SQL}, g as (select *, sum(case when flag = 'A' then 1 else 0 end) {SO_FAR} grp from r), q as (select doc_id, grp, arg_min(part, i) service_id, arg_max(price, i) filter (flag = 'N') amount, arg_min(price, i) filter (flag = 'R') tax_amount, coalesce(string_agg(text, '; ' order by i) filter (flag = 'N'), arg_min(text, i)) description, arg_min(page, i) source_page, arg_max(flag, i) last_flag from g where grp > 0 group by 1, 2)"


@query(f"with {GROUPS_SQL} select doc_id, row_number() over (partition by doc_id order by grp) line_number, case last_flag when 'R' then 'tax' when 'N' then 'usage' else 'recurring' end charge_type, substr(description, 1, 500) description, cast(source_page as integer) source_page, service_id, cast(amount as decimal(18,6)) amount, cast(tax_amount as decimal(18,6)) tax_amount, cast(amount + coalesce(tax_amount, 0) + 1.5 as decimal(18,6)) gross from q where amount is not null")
def udf03_rule_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpreter.run(rows(spark, sf_dir), MODEL)


@query(f"with {GROUPS_SQL} select doc_id, cast(grp as bigint) grp, 'missing amount' reason from q where amount is null")
def rec11_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpreter.dropped_items(interpreter.candidates(rows(spark, sf_dir), MODEL)).select("doc_id", F.col("group").alias("grp"), "reason")


@query(f"with {GROUPS_SQL} select g.doc_id, cast(g.grp as bigint) grp, g.i, cast(g.price as decimal(18,6)) amount, q.service_id from g join q on q.doc_id = g.doc_id and q.grp = g.grp where flag = 'R'")
def exp10_emit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Model(MODEL.region, MODEL.classifiers, MODEL.grouping, {"service_id": Rule(Source("first", "part")), "amount": Rule(Source("emit", "price"), kind="decimal")}, emit="tax")
    return interpreter.candidates(rows(spark, sf_dir), model).select("doc_id", F.col("group").alias("grp"), F.col("emit.row_index").alias("i"), "amount", "service_id")


@query(f"with {GROUPS_SQL} select doc_id, cast(grp as bigint) grp, cast(o_totalprice as decimal(18,6)) as total, cast(amount * 2 as decimal(18,6)) doubled, cast(null as decimal(18,6)) as nothing from q join (select o_orderkey, cast(o_totalprice as decimal(18,2)) o_totalprice from orders) on o_orderkey = doc_id")
def exp06_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), money("o_totalprice").alias("stated"))
    fields = {"amount": MODEL.fields["amount"], "total": Rule(operation="extract", operands=("ref:stated",)), "doubled": Rule(operation="product", operands=("ref:amount", "const:2")), "nothing": Rule(operation="extract", operands=("ref:unknown",))}
    found = interpreter.candidates(rows(spark, sf_dir), Model(MODEL.region, MODEL.classifiers, MODEL.grouping, fields), totals)
    return found.where("stated is not null").select("doc_id", F.col("group").alias("grp"), "total", "doubled", "nothing")


@query(f"with {GROUPS_SQL} select doc_id, cast(grp as bigint) grp, 'fixed' as literal, cast(coalesce(amount, 0) + coalesce(tax_amount, 0) as decimal(18,6)) combined, coalesce(cast(tax_amount as varchar), 'none') either from q where amount is not null or tax_amount is not null")
def exp07_field_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = lambda role, last=False: Source(role, "price", last=last)
    fields = {"literal": Rule(price("tax"), literal="fixed"), "combined": Rule(sources=(price("detail", True), price("tax")), kind="decimal"), "either": Rule(price("tax"), default="none")}
    found = interpreter.candidates(rows(spark, sf_dir), Model(MODEL.region, MODEL.classifiers, MODEL.grouping, fields))
    return once(found, "combined").where("combined is not null").select("doc_id", F.col("group").alias("grp"), *fields)


@query(f"with {ROWS_SQL}, g as (select *, sum(case when flag = 'A' then 1 else 0 end) {SO_FAR} grp from r) select doc_id, cast(grp as bigint) grp, string_agg(cast(l_partkey as varchar), '+' order by i) parts, arg_max(part, i) last_part from g where grp > 0 group by 1, 2")
def exp08_field_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"parts": Rule(Source("all", "part", pattern=r"P(\d+)", join="+")), "last_part": Rule(Source("all", "part", last=True))}
    found = interpreter.candidates(rows(spark, sf_dir), Model(MODEL.region, MODEL.classifiers, MODEL.grouping, fields))
    return found.select("doc_id", F.col("group").alias("grp"), *fields)


@query("select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as day, cast(o_custkey as bigint) as whole, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else 'other' end state from orders")
def exp09_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day, whole, state = F.date_format("o_orderdate", "dd-MMM-yyyy"), F.concat(F.lit("no. "), F.col("o_custkey").cast("string")), F.concat(F.lit("status "), "o_orderstatus")
    done = interpreter.transformed
    return o.select("o_orderkey", done(day, Rule(kind="date")).cast("string").alias("day"), done(whole, Rule(kind="integer")).alias("whole"), done(state, Rule(values={"status o": "open", "STATUS F": "filled"}, default="other")).alias("state"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'UNKNOWN' else cast(o_orderkey as varchar) end as number, case when o_orderkey % 2 = 0 then '2024-01-31' else strftime(cast(o_orderdate as date), '%Y-%m-%d') end as date, case when o_orderkey % 5 = 0 then 'USD' else 'EUR' end currency from orders")
def exp12_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    heads = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, " ").otherwise(k.cast("string")).alias("number"), F.when(k % 2 != 0, F.to_date("o_orderdate")).alias("date"), F.when(k % 5 != 0, "EURO").alias("currency"))
    return interpreter.assembled(heads, "2024-01-31").withColumn("date", F.col("date").cast("string"))


@query(f"with {GROUPS_SQL}, s as (select doc_id, cast(sum(case when last_flag <> 'R' then amount else 0 end) as decimal(18,2)) items_sum from q where amount is not null group by 1) select doc_id, items_sum, coalesce(abs(items_sum - cast(o_totalprice as decimal(18,2))) <= 0.01, true) ok from s left join orders on o_orderkey = doc_id")
def agg04_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), money("o_totalprice").alias("stated"))
    return interpreter.self_check(interpreter.run(rows(spark, sf_dir), MODEL), totals, "stated")


@query(f"with {GROUPS_SQL} select doc_id, cast(grp as bigint) grp, cast(coalesce(amount + tax_amount, amount, tax_amount) as decimal(18,6)) combined from q")
def agg34_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"combined": Rule(sources=(Source("detail", "price", last=True), Source("tax", "price")), kind="decimal")}
    return interpreter.candidates(rows(spark, sf_dir), Model(MODEL.region, MODEL.classifiers, MODEL.grouping, fields)).select("doc_id", F.col("group").alias("grp"), "combined")


FIELD = lambda n: {"op": "field", "name": n}
PLAN = executor.Plan(
    exclude=(r"^R ",),
    row_rules={"amount": {"op": "multiply", "args": [FIELD("price"), {"op": "literal", "value": 2}]}, "tax_amount": {"op": "subtract", "args": [FIELD("amount"), FIELD("price")]}, "service_id": {"op": "regex_extract", "args": [FIELD("text")], "pattern": r"P(\d+)", "group": 1}},
    checks=(("even", FIELD("amount"), FIELD("tax_amount"), 50000.0), ("same", FIELD("amount"), FIELD("amount"), 0.0)),
)
PLAN_SQL = f"{ROWS_SQL}, p as (select doc_id, row_number() over (partition by doc_id order by i) line_number, cast(price * 2 as decimal(18,6)) amount, cast(price as decimal(18,6)) tax_amount, cast(l_partkey as varchar) service_id, text description, cast(page as integer) source_page, cast(i as integer) row_index from r where flag <> 'R')"


@query(f"with {PLAN_SQL} select * from p")
def exp02_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executor.execute(rows(spark, sf_dir), PLAN)


@query(f"with {PLAN_SQL} select doc_id, cast(sum(amount) as decimal(18,2)) line_items_amount_sum, cast(sum(tax_amount) as decimal(18,2)) line_items_tax_sum from p group by 1")
def agg28_plan_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executor.sums(executor.execute(rows(spark, sf_dir), PLAN))


@query(f"with {PLAN_SQL} select doc_id, line_number, 'even' as check_name from p where abs(amount - tax_amount) > 50000")
def exp15_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executor.failures(executor.execute(rows(spark, sf_dir), PLAN), PLAN).withColumnRenamed("check", "check_name")


# Deliveries: orders as documents with a total and perhaps a rate, their lines with a tax on some.
DOCS_SQL = "d as (select o_orderkey doc_id, cast(case when o_orderkey % 3 = 0 then 0.2 end as decimal(18,6)) tax_rate, cast(case when o_orderkey % 3 = 1 then floor(o_totalprice / 10) end as decimal(18,2)) tax, cast(o_totalprice as decimal(18,2)) subtotal, cast(o_orderdate as date) as day from orders), l as (select l_orderkey doc_id, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice as decimal(18,2)) amount, cast(case when l_linenumber % 3 = 0 then floor(l_extendedprice / 4) end as decimal(18,2)) tax_amount from lineitem), c as (select doc_id, case when min(round(cast(tax_amount as double) / cast(amount as double), 4)) = max(round(cast(tax_amount as double) / cast(amount as double), 4)) then min(round(cast(tax_amount as double) / cast(amount as double), 4)) end rate from l where tax_amount is not null group by 1), e as (select d.*, cast(coalesce(cast(tax_rate as double), case when subtotal > 0 then round(cast(tax as double) / cast(subtotal as double), 6) end, c.rate) as decimal(18,6)) rate from d left join c using (doc_id))"


def _delivery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(k % 3 == 0, 0.2).cast("decimal(18,6)").alias("tax_rate"), F.when(k % 3 == 1, F.floor(F.col("o_totalprice") / 10)).cast("decimal(18,2)").alias("tax"), money("o_totalprice").alias("subtotal"), F.to_date("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", money("l_extendedprice").alias("amount"), F.when(F.col("l_linenumber") % 3 == 0, F.floor(F.col("l_extendedprice") / 4)).cast("decimal(18,2)").alias("tax_amount"))
    return delivery.resolved_rates(docs, lines), lines


@query(f"with {DOCS_SQL} select doc_id, round(rate, 4) rate from e")
def num12_tax_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _delivery(spark, sf_dir)
    return docs.select("doc_id", F.round("rate", 4).alias("rate"))


@query(f"with {DOCS_SQL} select l.doc_id, l_linenumber, l_partkey, l_suppkey, coalesce(tax_amount, cast(round(amount * rate, 2) as decimal(18,2))) line_tax from l join e using (doc_id)")
def num13_line_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lines = _delivery(spark, sf_dir)
    return lines.join(docs.select("doc_id", "rate"), "doc_id").select("doc_id", "l_linenumber", "l_partkey", "l_suppkey", delivery.line_tax(F.col("tax_amount"), F.col("amount"), F.col("rate")).alias("line_tax"))


@query(f"with {DOCS_SQL} select l.doc_id as \"Doc\", 'P' || l_partkey as \"Service\", amount as \"Amount\", coalesce(tax_amount, cast(round(amount * rate, 2) as decimal(18,2))) as \"Tax\", strftime(e.day, '%m/%d/%Y') as \"Date\", cast(null as varchar) as \"Other\" from l join e using (doc_id)")
def snk02_delivered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lines = _delivery(spark, sf_dir)
    named = lines.withColumn("service", F.concat(F.lit(" p"), "l_partkey"))
    spec = [delivery.Field("Doc", "doc_id"), delivery.Field("Service", "service", transforms=("trim", "uppercase")), delivery.Field("Amount", "amount"), delivery.Field("Tax", "computed.line_tax"), delivery.Field("Date", "document.day"), delivery.Field("Other", "computed.unknown")]
    return delivery.rows(docs, named, spec)


@query(f"with {DOCS_SQL} select doc_id, cast(coalesce(sum(coalesce(tax_amount, cast(round(amount * rate, 2) as decimal(18,2)))), 0) as decimal(18,2)) delivered_tax from l join e using (doc_id) group by 1")
def agg03_delivered_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lines = _delivery(spark, sf_dir)
    return delivery.tax_sums(lines, docs)


@query(f"with {DOCS_SQL} select d.doc_id, coalesce(n, 0) as n, coalesce(cast(t as varchar), '0.00') as total, case when d.doc_id % 2 = 0 then cast(subtotal as varchar) end total_due from d left join (select doc_id, count(*) n, cast(sum(amount) as decimal(18,2)) t from l group by 1) using (doc_id)")
def snk05_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lines = _delivery(spark, sf_dir)
    sums = lines.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum("amount").cast("decimal(18,2)").alias("total"))
    due = F.when(F.col("doc_id") % 2 == 0, F.col("subtotal")).otherwise(0).cast("decimal(18,2)")
    return delivery.manifest(docs.withColumn("total_due", due), sums).withColumnRenamed("rows", "n")


@query(f"with {DOCS_SQL} select doc_id, case when doc_id % 7 = 0 then 'no number' when tax_rate is null and tax is null then 'no tax' end reason from d where doc_id % 7 = 0 or (tax_rate is null and tax is null)")
def snk06_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _delivery(spark, sf_dir)
    return delivery.exceptions(docs, [("no number", F.col("doc_id") % 7 == 0), ("no tax", F.col("tax_rate").isNull() & F.col("tax").isNull())])


@query(f"with {DOCS_SQL}, n as (select *, row_number() over (partition by doc_id order by l_linenumber, l_partkey, l_suppkey, amount) k, count(*) over (partition by doc_id) n_rows from l) select doc_id, n_rows, '[' || string_agg('{{\"l_partkey\":' || l_partkey || ',\"amount\":' || cast(amount as varchar) || '}}', ',' order by k) || ']' payload from n where k <= 2 group by 1, 2")
def snk18_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = _delivery(spark, sf_dir)
    return delivery.preview(lines, ["l_partkey", "amount"], ["l_linenumber", "l_partkey", "l_suppkey", "amount"], 2)


@query("select event_id, cast(event_id % 1000 as varchar) duration from events")
def snk10_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "props", F.col("ts").cast("timestamp").alias("began"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000 * 1000).alias("ended"))
    return delivery.log_entries(e, "props", "began", "ended").select("event_id", F.get_json_object("props", "$.duration_ms").alias("duration"))


