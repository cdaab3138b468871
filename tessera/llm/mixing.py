"""Mixing sources to target weights, natively.

Every row has a place in [0, 2**60), from a digest of its id and its text.  The share of a source is the set of rows
below a threshold.  Sizes are summed by source and the leading digits of the place; a running sum over
these few buckets finds the one in which the budget ends, and only that bucket's rows are summed by the
next digits, until the place is fully resolved.  Thresholds for growing budgets are nested: a smaller
budget takes a subset.  No rows are sorted or gathered; a level's buckets are at most 4096 a source, and
targets are made from one row for each source.

A target above the source's size repeats the whole source and takes the rest by threshold.  Rows that repeat
both id and text have one place; if it is the threshold, as many of them are taken as come nearest to the
budget, which of these equal rows being open.  A null id is an id of its own.  Null texts have size 0, and so
have empty ones; very long texts count whole.  A null source is a source of its own, last in order; with no words at all nothing is taken.
An empty table gives an empty result.  Other columns of docs are kept; those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, own_names

WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the place, and those resolved by one histogram.
DIGITS, STEP = 15, 3


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and the controls from tab to carriage return."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(text.isNull() | (bare == ""), 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_key(source: Column) -> Column:
    """A string that is never null and keeps the order of sources, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(key, source_size, target) of (key, source_size), a row for each source.

    Capping and resharing until none is above its cap gives min(cap, level * weight); the level is found
    in the order of cap / weight, by running sums.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double")
    one = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, rest, all_rows = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the first level, in that order, that leaves its own source below its cap
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    levels = one.withColumn("level", level).withColumn("level", F.first(fits, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return levels.select("key", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(work: Workspace, rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, edge, sum, size, rows, budget): rows of (key, place, size) with place < edge sum up to `sum`, those at the edge, `rows` in number, to `size`.

    budgets: (key, budget).  A source whose rows all fit has no edge.
    """
    state, settled = budgets.select("key", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("sum")), []
    for start in range(0, DIGITS, STEP):
        inside = rows.withColumn("prefix", F.substring("place", 1, start)).join(state, ["key", "prefix"])
        sums = inside.groupBy("key", "budget", "prefix", "sum", F.substring("place", start + 1, STEP).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("place").alias("lo"), F.max("place").alias("hi"))
        reached = F.col("sum") + F.sum("size").over(Window.partitionBy("key").orderBy("bucket"))
        over = sums.withColumn("reached", reached).where("reached > budget")
        edge = F.min_by(F.struct("budget", F.concat("prefix", "bucket").alias("prefix"), (F.col("reached") - F.col("size")).alias("sum"), "size", "rows", "lo", "hi"), "bucket")
        found = work.put(over.groupBy("key").agg(edge.alias("e")).select("key", "e.*"), "edges")
        settled.append(found.where("lo = hi").select("key", F.col("lo").alias("edge"), "sum", "size", "rows", "budget"))
        state = found.where("lo < hi").select("key", "budget", "prefix", "sum")
        if state.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def mix(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """The rows of docs with size, source_size, target and copies, how often the mix takes the row.

    All sources share 100% of all sizes by weight, in order of their names.
    """
    work = Workspace(spark, "mixing")
    docs = docs.drop(*({"size", "source_size", "target", "copies"} - {id_col, text_col, source_col}))
    place = F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(text_col, F.lit(""))).cast("binary")), 1, DIGITS)
    rows = work.put(docs.select(source_key(F.col(source_col)).alias("key"), place.alias("place"), words(F.col(text_col)).alias("size")), "sizes")
    per_source = work.put(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = per_source.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    edges = thresholds(work, rows, plan.where("source_size > 0").select("key", "budget"))
    # of the rows at the edge, all of one size, as many are taken as bring the sum nearest to the budget
    share = (F.col("budget") - F.col("sum")) * F.col("rows") / F.col("size")
    at_edge = F.ceil(share - 0.5)
    key, put, edge, some, turn, once, many = own_names(docs, "_key", "_place", "_edge", "_some", "_turn", "_whole", "_rows")
    planned = plan.join(edges.select("key", "edge", at_edge.alias("at_edge"), "rows"), "key", "left")
    plan = work.put(planned.select(F.col("key").alias(key), "source_size", "target", F.col("whole").alias(once), F.col("edge").alias(edge), F.col("at_edge").alias(some), F.col("rows").alias(many)), "plan")
    placed = docs.withColumns({key: source_key(F.col(source_col)), put: place, "size": words(F.col(text_col))}).join(plan, key)
    at = F.coalesce(F.col(put) == F.col(edge), F.lit(False))
    tied = at & (F.col(many) > 1)
    single = F.when((F.col(put) < F.col(edge)) | (at & (F.col(some) > 0)), 1).otherwise(0)
    if plan.where(F.col(many) > 1).isEmpty():
        out = placed.withColumn("copies", (F.col(once) + single).cast("long"))
    else:  # equal rows at an edge are numbered
        numbered = placed.where(tied).withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(put))).withColumn("copies", (F.col(once) + (F.col(turn) <= F.col(some)).cast("int")).cast("long")).drop(turn)
        out = placed.where(~tied).withColumn("copies", (F.col(once) + single).cast("long")).unionByName(numbered)
    return out.drop(key, put, once, edge, some, many)


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return mixed.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken."""
    return mixed.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("_n", "size", "source_size", "target", "copies")


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce('c' || source, 'n') k, substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size
  from documents),
s as (select k, cast(sum(size) as bigint) source_size, row_number() over (order by k) i from d group by k),
w as (select *, cast(case (i - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as double) weight, source_size * 3.0::double cap from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, k rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by cap / weight, k rows between current row and unbounded following) lev from w),
v as (select min_by(lev, {'r': cap / weight, 'k': k}) filter (lev * weight <= cap) level from l),
t as (select k, source_size, least(cap, coalesce(weight * level, cap)) target from l, v),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end whole from t),
g as (select k, place, sum(size) size from d group by all),
r as (select g.*, sum(size) over (partition by k order by place) reached from g),
e as (select k, place, reached, size, target - whole * source_size budget from r join p using (k)),
x as (select *, row_number() over (partition by k order by place) n from e where reached > budget),
c as (select k, place edge, (reached - budget) < (budget - (reached - size)) at_edge from x where n = 1)
select doc_id, cast(size as bigint) size, source_size, cast(target as double) target,
       cast(size * (whole + case when place < edge or (place = edge and at_edge) then 1 else 0 end) as bigint) taken
from d join p using (k) left join c using (k)
"""
