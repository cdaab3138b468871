"""Queries of what a profile declares: labels, policies, bands, fields, and the tables around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import amounts
from .functions import text as t
from .models import BEFORE, ROWS_SQL, flag, rows
from .operators import delivery, evaluation, joins, layout, policies, ranking, sequences, store
from .readings import KEY, WORDS_SQL, _cells
from .registry import money, query, table
from .sources import payloads, words

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# Layout.
@query(f"with {WORDS_SQL} select doc_id, page, word_no, round(x0 / 612 * 1000, 2) nx0, round((ln * 12.0) / 792 * 1000, 2) ny0, 0.0 as flat from (select *, row_number() over (partition by doc_id, page order by ln, k) word_no from w)")
def lay04_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page are numbered by their place in its array, without a sort."""
    w = words.pages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    numbered = w.select("doc_id", "page", F.posexplode("w").alias("k", "word")).select("doc_id", "page", (F.col("k") + 1).alias("word_no"), "word.*")
    return numbered.select("doc_id", "page", F.col("word_no").cast("long").alias("word_no"), layout.normalized(F.col("x0"), F.lit(612.0)).alias("nx0"), layout.normalized(F.col("y0"), F.lit(792.0)).alias("ny0"), layout.normalized(F.col("y0"), F.lit(0.0)).alias("flat"))


#: Texts set in two columns: four words make a row, rows alternate from left to right of the middle.
COLUMNS_SQL = f"{WORDS_SQL}, z as (select *, dense_rank() over (partition by doc_id, page order by ln, k // 4) - 1 r, length(word) n from w), s as (select doc_id, page, r, n, 10 + 320 * (r % 2) + 5.0 * coalesce(sum(n + 1) over (partition by doc_id, page, r order by k rows between unbounded preceding and 1 preceding), 0) x0 from z)"


def _two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = words.from_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    k, page = F.col("word_seq") % 10000, Window.partitionBy("doc_id", "page")
    placed = w.withColumn("row_index", F.dense_rank().over(page.orderBy(F.expr("word_seq div 10000"), F.floor(k / 4))) - 1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id", "page", "row_index").orderBy("word_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x0 = 10 + 320 * (F.col("row_index") % 2) + 5.0 * before
    return placed.withColumn("x0", x0).withColumn("x1", F.col("x0") + 5.0 * F.length("text")).select("doc_id", "page", "row_index", "x0", "x1", "page_width")


@query(f"with {COLUMNS_SQL}, v as (select *, x0 + 5.0 * n x1 from s), g as (select doc_id, page, count(*) w, count(distinct r) n, min(x0) c0, max(x1) c1 from v group by all having n >= 15 and w >= 40 and c1 - c0 >= 612 * 0.45), "
    "x as (select *, c0 + 0.35 * (c1 - c0) + 3.0 * k as x from (select *, unnest(range(0, cast(0.3 * (c1 - c0) / 3 as bigint) + 2)) k from g)), rr as (select doc_id, page, r, min(x0) r0, max(x1) r1 from v group by all), "
    "lr as (select doc_id, page, x.x, any_value(n) n, any_value((c0 + c1) / 2) centre, count(*) filter (r1 <= x.x) lft, count(*) filter (r0 >= x.x) rgt from x join rr using (doc_id, page) where x.x <= c0 + 0.65 * (c1 - c0) group by all), "
    "q as (select * from lr where (lft + rgt) / n >= 0.6 and least(lft, rgt) >= 0.15 * n), a as (select q.*, (select count(*) from v where v.doc_id = q.doc_id and v.page = q.page and v.x0 < q.x and q.x < v.x1) cross_ from q) "
    "select doc_id, page, (lft + rgt) / n as fraction, x, round(x / 612 * 1000, 2) normal_x from a qualify row_number() over (partition by doc_id, page order by abs(lft - rgt), cross_, abs(x - centre), x) = 1")  # fmt: skip
def lay07_gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gutters(_two_columns(spark, sf_dir))


@query(f"with {ROWS_SQL}, k as (select doc_id, i, i * 12 + case when i >= 3 then 100 else 0 end y from r where l_partkey % 4 > 0), t as (select *, case when y - lag(y + 10) over (partition by doc_id order by i) > 60 then 1 else 0 end cut from k) select doc_id, i, cast(1 + sum(cut) over (partition by doc_id order by i) as integer) as table_no from t")
def lay14_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("i") * 12 + F.when(F.col("i") >= 3, 100).otherwise(0)
    r = rows(spark, sf_dir).withColumns({"page": F.lit(1), "y0": y, "y1": y + 10})
    return layout.table_regions(r, F.col("l_partkey") % 4 > 0).select("doc_id", "i", F.col("table").alias("table_no"))


@query(f"with {ROWS_SQL} select doc_id, part band, 100.0 lo, 290.0 hi from r where i = 0")
def lay15_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = rows(spark, sf_dir).where("i = 0").select("doc_id", "page", F.explode("cells").alias("c")).select("doc_id", "page", "c.*")
    return layout.bands(header).where("lo = 100").select("doc_id", "band", "lo", "hi")


@query(f"with {ROWS_SQL} select doc_id, i, case when i = 0 then null else part end ident from r")
def jn08_cells_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    cells = r.select("doc_id", F.lit(1).alias("page"), F.col("i").alias("row_index"), F.explode("cells").alias("c")).select("doc_id", "page", "row_index", "c.*")
    bands = layout.bands(cells.where("row_index = 0"))
    held = layout.cells_by_band(cells.where("row_index > 0"), bands).where("x0 = 120").select("doc_id", F.col("row_index").alias("i"), F.col("text").alias("ident"))
    return r.select("doc_id", "i").join(held, ["doc_id", "i"], "left")


@query(f"with {ROWS_SQL} select doc_id, i, text, flag || '/' || part || '/' || cast(price as varchar) cells from r")
def lay18_parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as one line of text with markup, and read back."""
    cells = F.transform("cells", lambda c: F.struct(c["text"].alias("text"), F.lit("text").alias("role"), c["x0"].alias("x0"), c["x1"].alias("x1")))
    line = layout.rendered(F.format_string("p%d.r%d", "page", F.col("i") + 1), F.lit("detail"), cells)
    return rows(spark, sf_dir).select("doc_id", "i", layout.without_markup(line).alias("text"), F.array_join(layout.unrendered(line), "/").alias("cells"))


@query(f"with {ROWS_SQL} select doc_id, i, text as plain from r")
def lay19_without_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform("cells", lambda c: F.struct(c["text"].alias("text"), F.lit("amount").alias("role"), c["x0"].alias("x0"), c["x1"].alias("x1")))
    return rows(spark, sf_dir).select("doc_id", "i", layout.without_markup(layout.rendered(F.lit("p1.r1"), F.lit("x"), cells)).alias("plain"))


@query(f"with {ROWS_SQL} select doc_id, page, count(*) n, count(*) filter (flag = 'R') totals, count(*) filter (price > 50000) large from r group by 1, 2")
def agg18_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"), F.count_if(flag("R")).alias("totals"), F.count_if(F.element_at(amounts.money_tokens(F.col("text")), -1) > 50000).alias("large"))


@query(f"with {ROWS_SQL}, s as (select doc_id, page, count(*) filter (flag = 'A') h, count(*) filter (flag = 'R') m from r group by 1, 2), c as (select *, h * 2 + least(8, m // 3) score from s) select doc_id, cast(page as integer) as page, cast(score as bigint) score from (select *, max(score) over (partition by doc_id) peak from c) where score > 0 and score >= greatest(1, peak // 3)")
def win15_structural_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rows(spark, sf_dir).groupBy("doc_id", "page").agg(F.count_if(flag("A")).alias("h"), F.count_if(flag("R")).alias("m"))
    return policies.structural_pages(pages, ["doc_id"], F.col("h"), F.col("m")).select("doc_id", "page", "score")


@query("with x as (select *, max(turn) over (partition by conv_id) last from conversations), k as (select conv_id, turn, row_number() over (partition by conv_id order by case when turn < 2 then 0 when turn = last then 1 when role = 'assistant' then 2 else 3 end, turn) n from x) select conv_id, string_agg(cast(turn as varchar), ',' order by turn) pages from k where n <= 4 group by 1")
def srt07_context_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    top = ranking.by_tiers(c, ["conv_id"], [F.col("turn") < 2, F.col("turn") == F.col("last"), F.col("role") == "assistant"], [F.col("turn")], 4)
    return top.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("turn")), ",").alias("pages"))


# Rows and labels.
@query(f"with {ROWS_SQL} select doc_id, i, flag = 'A' as rejected from r")
def flt12_other_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(flag("A"), F.concat(F.lit("due DATE: "), "flag")).when(flag("N"), F.concat(F.lit("due date is long after "), "part", F.lit(" came"))).otherwise(F.lit("Total 5"))
    return rows(spark, sf_dir).select("doc_id", "i", policies.other_label(value, "Total", ["Total", "Due date"]).alias("rejected"))


@query(f"with {ROWS_SQL} select doc_id, i from r where flag = 'A'")
def flt16_account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(flag("A"), F.concat_ws(" ", "part", F.lit("1.50"), F.col("price").cast("string"))).when(flag("N"), F.concat_ws(" ", F.lit("VAT 1.50"), F.col("price").cast("string"))).otherwise(F.col("text"))
    return rows(spark, sf_dir).where(policies.account_row(line, F.lit("detail"))).select("doc_id", "i")


@query("select p_partkey, 'approved' as kind from part where p_partkey % 3 = 0 and p_size % 2 = 0 union all select p_partkey, 'candidate' from part where p_partkey % 3 = 1 and p_size % 2 = 0")
def flt26_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    m = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "approved").when(k == 1, "candidate").otherwise("failed").alias("status"), F.when(F.col("p_size") % 2 == 1, "other").when(k == 0, "fp").alias("fingerprint"))
    return policies.routable(m, F.lit("fp")).select("p_partkey", F.lit("approved").alias("kind")).union(policies.routable(m, F.lit("fp"), candidate=True).select("p_partkey", F.lit("candidate")))


@query("select p_partkey, p_partkey % 3 = 0 or p_size % 2 = 0 as candidate from part")
def flt31_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("p_partkey") % 3 == 0, "header").otherwise("detail")
    cell = lambda r: F.struct(F.lit("x").alias("text"), r.alias("role"))
    cells = F.array(cell(F.lit("text")), cell(F.when(F.col("p_size") % 2 == 0, "summary").otherwise("text")))
    return table(spark, sf_dir, "part").select("p_partkey", policies.table_candidate(role, cells).alias("candidate"))


@query("select c_custkey, c_custkey % 2 = 0 and c_nationkey >= 12 as eligible from customer")
def flt32_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("enabled", F.col("c_custkey") % 2 == 0), ("pages", F.col("c_nationkey") >= 12)]
    return evaluation.readiness(table(spark, sf_dir, "customer"), checks).select("c_custkey", F.col("ready").alias("eligible"))


@query("select p_partkey, case when p_partkey % 6 = 0 then 'table,total' when p_partkey % 2 = 0 then 'table' when p_partkey % 3 = 0 then 'total' else '' end detectors from part")
def flt33_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("id").alias("id_column"), F.when(k % 2 == 0, "header").alias("table_header"), F.when(k % 3 == 0, "total").alias("total_label"))
    return policies.detectors(p, {"table": ("id_column", "table_header"), "total": ("total_label",)}).select("p_partkey", "detectors")


@query(f"with {ROWS_SQL} select doc_id, i, cast(price as varchar) as value from r")
def exp03_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).withColumn("line", F.concat(F.lit("Amount due: "), F.col("price").cast("string")))
    return r.select("doc_id", "i", t.after_label(F.col("line"), "amount DUE").alias("value"))


@query(f"with {ROWS_SQL} select doc_id, 'Price' as label, cast(min_by(price, i) as decimal(18,6)) as amount from r where ln = 1 group by 1")
def exp13_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("ln") == 1, F.concat(F.lit("20% price "), F.col("price").cast("string"))).otherwise("x")
    found = policies.label_lookup(rows(spark, sf_dir).withColumn("text", line), {"Price": "amount"}, "doc_id")
    return found.select("doc_id", "label", amounts.printed_amount(F.col("value"), ignore_percent=True).alias("amount"))


@query(f"with {ROWS_SQL} select doc_id, i, cast(price as decimal(18,2)) amount from r where flag = 'A'")
def exp11_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.interpreter import Model, Region, Rule, Source
    from .plans.interpreter import run as run_model

    model = Model(Region(columns={"price": (300.0, 400.0)}), (("item", {"row_text": "^A "}),), ("single", "item"), {"amount": Rule(Source("first", "price"), kind="decimal"), "place": Rule(Source("first", pattern=r"^A P(\d+)"))})
    found = run_model(rows(spark, sf_dir), model).select("doc_id", "place", F.col("amount").cast("decimal(18,2)").alias("amount"))
    keyed = rows(spark, sf_dir).where(flag("A")).select("doc_id", "i", F.col("l_partkey").cast("string").alias("place"), F.col("price").alias("amount"))
    return keyed.join(found.distinct(), ["doc_id", "place", "amount"]).select("doc_id", "i", "amount")


@query(f"with {ROWS_SQL}, s as (select *, last_value(case when flag = 'A' then part end ignore nulls) {BEFORE} ident from r) select 'table' as detector, doc_id, i from r where flag = 'A' union all select 'charge', doc_id, i from s where ident is not null and flag = 'N'")
def rec05_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import grouping

    r = rows(spark, sf_dir)
    charge = grouping.charge_candidates(r, ["doc_id"], ["i"], F.when(flag("A"), F.col("part")), F.when(flag("N"), F.col("price")))
    return r.where(flag("A")).select(F.lit("table").alias("detector"), "doc_id", "i").union(charge.select(F.lit("charge"), "doc_id", "i"))


@query(f"with {ROWS_SQL} select doc_id, arg_min(part, i) as default_value from r where flag <> 'N' group by 1")
def rec08_context_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).select("doc_id", "i", "flag", F.concat(F.lit("Ref: "), "part").alias("text"))
    return policies.context_defaults(r, r.where(flag("N")), ["doc_id"], "i", "Ref").withColumnRenamed("default", "default_value")


@query("select p_partkey, cast(p_size as decimal(18,2)) first_amount, cast(7 as decimal(18,2)) group_total, cast(9.5 as decimal(18,2)) charges from part")
def num08_amount_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.col("p_size").cast("decimal(18,2)"), F.lit("9.5").cast("decimal(18,2)"), F.lit("3").cast("decimal(18,2)"))
    pick = lambda p: policies.amount_by(p, values, F.lit("7").cast("decimal(18,2)"), F.lit(None))
    return table(spark, sf_dir, "part").select("p_partkey", pick("first_amount").alias("first_amount"), pick("group_total").alias("group_total"), pick("table_charges_column").alias("charges"))


@query("select p_partkey, cast(null as decimal(18,2)) as no_tax, cast(p_size + 1.5 as decimal(18,2)) labelled, cast(nullif(p_size - 10, 0) as decimal(18,2)) rest from part")
def num09_tax_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("decimal(18,2)")
    pick = lambda p: policies.tax_by(p, F.array(d(F.col("p_size")), d(F.lit("1.5"))), F.lit(None), d(F.col("p_size")), d(F.lit("10")))
    return table(spark, sf_dir, "part").select("p_partkey", pick("none").alias("no_tax"), pick("label_amount").alias("labelled"), pick("total_less_amount").alias("rest"))


@query("select o_orderkey, cast(round(cast(o_totalprice as decimal(18,2)), 2) as decimal(18,2)) number, strftime(cast(o_orderdate as date), '%m/%d/%Y') as day, o_orderpriority as text from orders")
def num17_delivered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = delivery.delivered_value
    return table(spark, sf_dir, "orders").select("o_orderkey", v(money("o_totalprice"), "decimal(18,2)").alias("number"), v(F.to_date("o_orderdate"), "date").alias("day"), v(F.col("o_orderpriority"), "string").alias("text"))


@query(f"select {KEY}, case l_linenumber % 3 when 0 then 'AB-' || (l_partkey + 10000) when 1 then '12345678' end ident from lineitem")
def str05_service_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    line = F.when(n == 0, F.concat(F.lit(" AB-"), F.col("l_partkey") + 10000, F.lit(" plan 3.00"))).when(n == 1, "123456781,234.50").otherwise("plain words 3.00")
    return table(spark, sf_dir, "lineitem").select(*LINE, money("l_extendedprice").alias("price"), policies.service_id(line).alias("ident"))


@query(f"with {ROWS_SQL}, b as (select *, sum(case when flag = 'A' then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) block from r) select doc_id, cast(block as bigint) block, string_agg(part, ' ' order by i) reference from b where block > 0 group by 1, 2")
def str17_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.reference(rows(spark, sf_dir), ["doc_id"], "i", F.col("part"), flag("A"))


@query(f"with {ROWS_SQL}, v as (select *, case when flag = 'R' then part end p from r) select doc_id, i, coalesce(p, lead(p, 1) over w, lead(p, 2) over w, lead(p, 3) over w, lead(p, 4) over w) found from v window w as (partition by doc_id order by i) qualify flag = 'A'")
def dat04_after_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.value_after(rows(spark, sf_dir), ["doc_id"], "i", flag("A"), F.when(flag("R"), F.col("part"))).select("doc_id", "i", "found")


@query("select p_partkey, 3 as third_last, cast(null as integer) as missing, 2 as n, p_size as last_one from part")
def arr01_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.lit(3), F.lit(5), F.col("p_size").cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", amounts.from_end(a, 3).alias("third_last"), amounts.from_end(a, 4).alias("missing"), F.size(F.slice(a, 1, 2)).alias("n"), amounts.from_end(a, 1).alias("last_one"))


@query("select s_suppkey as service_id, s_name as description from supplier")
def map01_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").alias("sid"), F.col("s_name").alias("d"))).alias("p"))
    return payloads.typed(s, "p", "sid long, d string", {"sid": "service_id", "d": "description"}).select("service_id", "description")


COERCED = {"whole": "integer", "price": "decimal", "day": "date", "names": "list", "kind": "enum", "note": "string"}


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("whole"), money("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"), F.lit("a, b ,A").alias("names"), F.when(k % 2 == 0, "TAX ").otherwise("else").alias("kind"), F.lit("  ").alias("note"))


@query("select o_orderkey, case when o_orderkey % 3 <> 0 then o_custkey end as whole, cast(o_totalprice as decimal(18,6)) price, strftime(cast(o_orderdate as date), '%Y-%m-%d') as day, 'a|b' as names, case when o_orderkey % 2 = 0 then 'tax' else 'recurring' end as kind, cast(null as varchar) note from orders")
def coe01_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = policies.coerced(_fields(spark, sf_dir), COERCED, {"kind": ("recurring", "tax", "fee")})
    return done.withColumns({"day": F.col("day").cast("string"), "names": F.array_join("names", "|")})


@query("select o_orderkey, o_orderkey % 3 <> 0 as valid from orders")
def coe02_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("o_orderkey", amounts.printed_amount(F.col("whole")).isNotNull().alias("valid"))


@query("select o_orderkey, o_custkey as whole, cast(o_totalprice as decimal(18,6)) price from orders")
def jsn01_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("whole"), money("o_totalprice").alias("price"), F.lit("x").alias("unknown"))).alias("p"))
    return payloads.typed(o, "p", policies.schema_of({"whole": "integer", "price": "decimal"})).drop("p")


@query("select o_orderkey, '{\"day\":\"' || strftime(cast(o_orderdate as date), '%m/%d/%Y') || '\",\"key\":' || o_custkey || '}' as payload from orders")
def jsn03_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(delivery.delivered_value(F.to_date("o_orderdate"), "date").alias("day"), F.col("o_custkey").alias("key"))).alias("payload"))


@query("select 'A' as code, p_partkey, upper(trim(p_brand)) as shout, regexp_replace(p_brand, '[^0-9]', '', 'g') digits from part")
def udf02_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_brand")
    return table(spark, sf_dir, "part").select(F.lit("A").alias("code"), "p_partkey", t.transformed(p, ["trim", "uppercase"]).alias("shout"), t.transformed(p, ["digits_only"]).alias("digits"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(null as varchar) as nothing, cast(l_linenumber as decimal(18,2)) tax from lineitem")
def udf01_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*LINE, F.lit(1).alias("doc_id"), money("l_extendedprice").alias("amount"), F.col("l_linenumber").cast("decimal(18,2)").alias("tax_amount"))
    docs = spark.createDataFrame([(1, None)], "doc_id int, rate decimal(18,6)")
    return delivery.rows(docs, lines, [*[delivery.Field(c, c) for c in LINE], delivery.Field("nothing", "computed.other"), delivery.Field("tax", "computed.line_tax")])


# Joins around records.
@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber // 3 as chunk from lineitem where l_returnflag = 'R'")
def jn29_row_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates go to every chunk that holds their row."""
    x = table(spark, sf_dir, "lineitem")
    chunks = x.select("l_orderkey", "l_linenumber", F.expr("l_linenumber div 3").alias("chunk")).distinct()
    return x.where("l_returnflag = 'R'").join(chunks, ["l_orderkey", "l_linenumber"]).select(*LINE, "chunk")


@query("select e.event_id, c.c_name as name from events e left join customer c on c.c_custkey = e.user_id where event_type = 'error'")
def jn30_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return table(spark, sf_dir, "events").where("event_type = 'error'").join(c, "user_id", "left").select("event_id", "name")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'true' when o_orderkey % 3 = 1 then 'F' end outcome from orders")
def jn31_run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run's details are a map by document."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    details = o.where(k % 3 < 2).select(F.create_map(k.cast("string"), F.when(k % 3 == 0, "true").otherwise("F")).alias("m"))
    held = details.select(F.explode("m").alias("k", "outcome")).select(F.col("k").cast("long").alias("o_orderkey"), "outcome")
    return o.select("o_orderkey").join(held, "o_orderkey", "left")


@query(f"with {ROWS_SQL} select doc_id, i, cast(price as decimal(18,6)) amount, part reference from r")
def jn32_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rows(spark, sf_dir).select("doc_id", "i", F.explode("cells").alias("c")).select("doc_id", "i", F.when(F.col("c.x0") == 120, F.concat(F.lit("P"), "c.text")).otherwise(F.col("c.text")).alias("text"), "c.x0", "c.x1")
    found = policies.in_band(cells, ["doc_id", "i"], 100.0, 400.0)
    return found.select("doc_id", "i", "amount", F.substring("reference", 2, 99).alias("reference"))


@query(f"with {ROWS_SQL} select doc_id, 116.0 lo, 200.0 hi from r where i = 0")
def jn33_header_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rows(spark, sf_dir).where("i = 0").select("doc_id", F.explode("cells").alias("c")).select("doc_id", F.when(F.col("c.x0") == 120, " Service ID").otherwise("x").alias("text"), "c.x0", "c.x1", F.col("c.x0").alias("seq"))
    return policies.header_bounds(cells, ["doc_id"], "service id", "seq")


@query("with r as (select o_custkey, o_orderkey, 'n' || o_custkey || ' ' || o_orderstatus as text from orders), m as (select o_custkey, min(o_orderkey) k from r group by 1) select o_custkey, unnest(['number', 'status']) as name, k o_orderkey from m")
def jn34_field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a document, one row each, with the first row that holds them."""
    o = table(spark, sf_dir, "orders")
    lines = o.select("o_custkey", "o_orderkey", F.concat(F.lit("n"), "o_custkey", F.lit(" "), "o_orderstatus").alias("text"))
    wide = o.select("o_custkey").distinct().select("o_custkey", F.concat(F.lit("n"), "o_custkey").alias("number"), F.lit(" ").alias("status"))
    fields = wide.unpivot("o_custkey", ["number", "status"], "name", "value")
    return joins.best_evidence(fields, lines, ["o_custkey"], F.array("value"), F.lit(1), ["o_orderkey"]).select("o_custkey", "name", "o_orderkey")


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'Over' else n_name end as header from nation")
def jn27_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("header"))
    return joins.overridden(base, base.where("n_nationkey % 2 = 0").withColumn("header", F.lit("Over")), ["n_nationkey"], ["header"])


# Aggregates, sets and sinks.
@query("select p_brand, bool_and(p_size > 1) and count(*) >= 2 approvable from part group by 1")
def agg30_approvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import rows as r

    return r.grades(table(spark, sf_dir, "part"), ["p_brand"], F.when(F.col("p_size") > 1, 1).otherwise(0)).select("p_brand", "approvable")


@query("select o_custkey, printf('%.2f', cast(sum(cast(o_totalprice as decimal(18,2))) as double)) total from orders group by 1")
def agg39_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.format_string("%.2f", F.sum(money("o_totalprice")).cast("double")).alias("total"))


@query("select l_orderkey, cast(count(*) filter (l_returnflag <> 'N') as bigint) rejected, round(count(distinct case when l_returnflag = 'N' then l_suppkey end) / count(distinct l_suppkey), 4) coverage from lineitem group by 1")
def agg40_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "N").alias("rejected"), F.round(F.count_distinct(kept) / F.count_distinct("l_suppkey"), 4).alias("coverage"))


@query("select user_id, string_agg(event_type, ',' order by f) messages from (select user_id, event_type, min(event_id) f from events group by 1, 2) group by 1")
def set10_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(held, lambda e: e["event_type"])), ",").alias("messages"))


@query("select p_partkey, case when p_partkey % 2 = 0 and p_partkey % 3 = 0 then 'old' when p_partkey % 3 = 0 then 'new' when p_partkey % 2 = 0 then 'old' else 'old' end as state from part")
def stm10_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    old = table(spark, sf_dir, "part").select("p_partkey", F.lit("old").alias("state"), F.when(k % 2 == 0, "approved").otherwise("draft").alias("status"))
    new = old.where(k % 3 == 0).withColumn("state", F.lit("new"))
    once = store.kept_approved(old, new, ["p_partkey"], "status")
    return store.kept_approved(once, new, ["p_partkey"], "status").select("p_partkey", "state")


@query("select user_id, event_id from events where event_type = 'view' qualify row_number() over (partition by user_id order by event_id desc) <= 2")
def dml10_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return ranking.by_tiers(views, ["user_id"], [F.lit(True)], [F.col("event_id").desc()], 2).select("user_id", "event_id")


@query("select c_custkey as \"Key\", c_name as \"Name\", cast(null as varchar) as \"Extra\" from customer")
def evl06_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_name", F.col("c_custkey").cast("string").alias("k"))
    return joins.aligned(c, ["name", "KEY "], ["Key", "Name", "Extra"]).withColumn("Key", F.col("Key").cast("long"))


@query("select o_orderkey, o_orderkey % 4 <> 0 as verified from orders")
def aut08_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    printed = F.concat(F.lit("Total due: "), money("o_totalprice").cast("string"))
    target = F.when(k % 4 == 0, "1.00").otherwise(money("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", evaluation.same_text(t.after_label(printed, "total due"), target).alias("verified"))


@query("select l_orderkey, sum(case when l_returnflag = 'R' then 1 else 0 end) ai_rows, sum(case when l_returnflag <> 'R' then 1 else 0 end) model_rows from lineitem group by 1")
def snk07_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("ai_rows"), F.count_if(F.col("l_returnflag") != "R").alias("model_rows"))


@query("select c_nationkey, '{' || string_agg('\"' || c_custkey || '\":\"' || c_name || '\"', ',' order by cast(c_custkey as varchar)) || '}' as snapshot from customer group by 1")
def snk15_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    return store.folded(c, "c_nationkey", "k", "c_name", "c_custkey").withColumnRenamed("progress", "snapshot")


@query("with p as (select conv_id, turn, role, case when role <> lag(role) over (partition by conv_id order by turn) or turn = 0 then 1 else 0 end n from conversations) select conv_id, count(*) parts from p where role = 'user' group by 1")
def src06_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one role stand for the lines of text blocks."""
    c = table(spark, sf_dir, "conversations").where("role = 'user' and trim(coalesce(text, 'x')) is not null")
    held = sequences.gap_clusters(c, ["conv_id"], "turn", 0).groupBy("conv_id", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("block"))
    return held.groupBy("conv_id").agg(F.count("*").alias("parts"))


@query("select regexp_extract(url, '^https?://([^/]+)', 1) folder, count(*) n, min(page_id) first_page from pages where url is not null group by 1")
def src16_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").where("url is not null").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("select d.doc_id, coalesce(case when quality = 1 then 'run' end, case when d.doc_id % 2 = 0 then 'status' end, 'none') found from documents d left join labels l on l.doc_id = d.doc_id")
def src21_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished run's record, else its status, else nothing."""
    runs = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("run").alias("run"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(runs, "doc_id", "left")
    return d.select("doc_id", F.coalesce("run", F.when(F.col("doc_id") % 2 == 0, "status"), F.lit("none")).alias("found"))


@query("select d.doc_id, case when l.doc_id is null then 'no truth' when d.doc_id % 5 = 0 then 'other layout' else 'example' end state from documents d left join labels l on l.doc_id = d.doc_id")
def src22_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("truth"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(truths, "doc_id", "left")
    return evaluation.routes(d, [("no truth", F.col("truth").isNull()), ("other layout", F.col("doc_id") % 5 == 0)], "example").select("doc_id", F.col("route").alias("state"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then s_name end as supplier_label, s_acctbal > 0 as active from supplier")
def src26_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old profiles have a map of labels, new ones a field for each."""
    k = F.col("s_suppkey")
    labels = F.when(k % 2 == 0, F.create_map(F.lit("supplier"), F.col("s_name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.get(F.map_values(labels), F.lit(0)).alias("supplier_label"), (F.col("s_acctbal") > 0).alias("active"))


@query("select 'default' as name, 0 as n union all select n_name, 1 from nation where n_nationkey % 5 = 0")
def src29_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in entry is there whatever the table holds."""
    there = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("name"), F.lit(1).alias("n"))
    return store.imported_if_absent(there, spark.createDataFrame([("default", 0)], "name string, n int"), ["name"])
