"""Groups of layout rows by policy: totals, markers, blocks, charges and candidates.

Rows have keys, an order and the columns that conditions name; every operator is windows over a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str], *, before: bool = False) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)


def marker_groups(rows: DataFrame, keys: list[str], order: list[str], start: Column, end: Column) -> DataFrame:
    """Rows with group 1, 2, ...: a start opens one (and closes the one before), an end closes it and belongs to it; a row that is both is a group of its own."""
    marked = rows.withColumns({"_start": start, "_end": end}).withColumn("group", F.sum(F.col("_start").cast("int")).over(_w(keys, order)).cast("long")).where("group > 0")
    closed = F.coalesce(F.max(F.col("_end").cast("int")).over(_w([*keys, "group"], order, before=True)), F.lit(0))
    return marked.withColumn("_closed", closed).where("_closed = 0").drop("_start", "_end", "_closed")


def total_groups(rows: DataFrame, keys: list[str], order: list[str], start: Column, total: Column, skip: Column) -> DataFrame:
    """Rows with group 1, 2, ...: from a start to the next total, which closes it; starts within an open group belong to it, skipped rows to none, and rows after the last total to none."""
    marked = rows.where(~skip).withColumns({"_start": start, "_total": total})
    marked = marked.withColumn("_closed", F.coalesce(F.sum(F.col("_total").cast("int")).over(_w(keys, order, before=True)), F.lit(0)))
    era = [*keys, "_closed"]
    opened = F.max(F.col("_start").cast("int")).over(_w(era, order)) == 1
    ends = F.max(F.col("_total").cast("int")).over(Window.partitionBy(*era)) == 1
    kept = marked.withColumns({"_open": opened, "_ends": ends}).where("_open and _ends")
    return kept.withColumn("group", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_closed")).cast("long")).drop("_start", "_total", "_closed", "_open", "_ends")


def block_items(rows: DataFrame, keys: list[str], order: list[str], ident: Column, tax: Column, emit: Column) -> DataFrame:
    """Rows that emit an item, with the identifier in force and the tax gathered since the item before; both begin anew with each identifier."""
    marked = rows.withColumns({"_ident": ident, "_tax": tax, "_emit": emit})
    marked = marked.withColumn("_block", F.sum(F.col("_ident").isNotNull().cast("int")).over(_w(keys, order))).where("_block > 0")
    block = [*keys, "_block"]
    marked = marked.withColumn("service", F.first("_ident", ignorenulls=True).over(_w(block, order)))
    marked = marked.withColumn("_since", F.coalesce(F.sum(F.col("_emit").cast("int")).over(_w(block, order, before=True)), F.lit(0)))
    gathered = F.coalesce(F.sum("_tax").over(_w([*block, "_since"], order)), F.lit(0))
    return marked.withColumn("tax", gathered.cast("decimal(18,2)")).where("_emit").drop("_ident", "_tax", "_emit", "_block", "_since")


def with_context(rows: DataFrame, keys: list[str], order: list[str], text: str, emit: Column, context: Column, *, joiner: str = " ") -> DataFrame:
    """Rows that emit, with the texts of the context rows since the one before, in order, then their own."""
    marked = rows.withColumns({"_emit": emit, "_context": context})
    marked = marked.withColumn("_since", F.coalesce(F.sum(F.col("_emit").cast("int")).over(_w(keys, order, before=True)), F.lit(0)))
    held = F.collect_list(F.when(F.col("_context") | F.col("_emit"), F.col(text))).over(_w([*keys, "_since"], order))
    return marked.withColumn("context", F.array_join(held, joiner)).where("_emit").drop("_emit", "_context", "_since")


def charge_candidates(rows: DataFrame, keys: list[str], order: list[str], ident: Column, amount: Column) -> DataFrame:
    """Rows with an amount, and the identifier last seen at or above them; rows before any identifier give none."""
    carried = F.last("_ident", ignorenulls=True).over(_w(keys, order))
    return rows.withColumns({"_ident": ident, "amount": amount}).withColumn("ident", carried).where("amount is not null and ident is not null").drop("_ident")


def marker_candidates(rows: DataFrame, keys: list[str], order: str, ident: Column, total: Column, amount: Column) -> DataFrame:
    """(keys, block, ident, amount, at) of blocks that begin with an identifier: the first total with an amount, else the last row with one."""
    marked = rows.withColumns({"_ident": ident, "_total": total, "_amount": amount})
    marked = marked.withColumn("block", F.sum(F.col("_ident").isNotNull().cast("int")).over(_w(keys, [order])).cast("long")).where("block > 0 and (_amount is not null or _ident is not null)")
    first_total = F.min(F.when(F.col("_total") & F.col("_amount").isNotNull(), F.struct(order, "_amount")))
    last = F.max(F.when(F.col("_amount").isNotNull(), F.struct(order, "_amount")))
    found = marked.groupBy(*keys, "block").agg(F.max("_ident").alias("ident"), F.coalesce(first_total, last).alias("f"))
    return found.where("f is not null").select(*keys, "block", "ident", F.col("f._amount").alias("amount"), F.col(f"f.{order}").alias("at"))


def billable(rows: DataFrame, keys: list[str], order: list[str], ident: Column, amount: Column) -> DataFrame:
    """(keys, idents): in order, the distinct identifiers in force on rows with an amount that is not zero."""
    found = charge_candidates(rows, keys, order, ident, amount).where("amount <> 0")
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("ident")).alias("idents"))


def summary_items(rows: DataFrame, keys: list[str], order: list[str], section: Column, start: Column, amounts: str, skip: Column) -> DataFrame:
    """Rows of a section that start a service and have three amounts: the third from the end is tax, the second the amount; nothing after the first skipped row behind an item."""
    inside = F.max(section.cast("int")).over(_w(keys, order, before=True)) == 1
    item = F.coalesce(inside, F.lit(False)) & start & (F.size(amounts) >= 3)
    marked = rows.withColumns({"_item": item, "_skip": skip})
    marked = marked.withColumn("_seen", F.coalesce(F.max(F.col("_item").cast("int")).over(_w(keys, order, before=True)), F.lit(0)) == 1)
    marked = marked.withColumn("_over", F.max((F.col("_seen") & F.col("_skip")).cast("int")).over(_w(keys, order)) == 1)
    return marked.where("_item and not _over").withColumns({"tax": F.element_at(amounts, -3), "amount": F.element_at(amounts, -2)}).drop("_item", "_skip", "_seen", "_over")


def segments(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, n, ident, segment): what stands from each match of the pattern up to the next; the pattern's first group is the identifier."""
    marked = F.regexp_replace(F.col(text), pattern, "\u0001$0")
    parts = texts.select(key, F.posexplode(F.split(marked, "\u0001")).alias("n", "segment")).where("n > 0")
    return parts.select(key, F.col("n").cast("long").alias("n"), F.regexp_extract("segment", pattern, 1).alias("ident"), "segment")


def grounded(rows: DataFrame, candidates: DataFrame, doc: str, row_ref: str, ident: str) -> DataFrame:
    """Rows with outcome: kept, no row (without a row that it names) or unknown identifier (one that no candidate of the document has)."""
    known = candidates.select(doc, F.col(ident), F.lit(True).alias("_known")).distinct()
    state = F.when(F.col(row_ref).isNull(), "no row").when(F.col(ident).isNotNull() & F.col("_known").isNull(), "unknown identifier").otherwise("kept")
    return rows.join(known, [doc, ident], "left").withColumn("outcome", state).drop("_known")


def plan_region(rows: DataFrame, keys: list[str], order: list[str], page: str, start: Column, end: Column, *, include_start: bool = False, include_end: bool = False, first_only: bool = False, max_pages: int | None = None) -> DataFrame:
    """Rows from start markers to end markers, which every start opens anew; max_pages counts pages from the last start, first_only stops where the region closes."""
    marked = rows.withColumns({"_start": start, "_end": end & ~start})
    marked = marked.withColumn("_open", F.sum(F.col("_start").cast("int")).over(_w(keys, order))).where("_open > 0")
    run = [*keys, "_open"]
    first_page = F.first(page).over(_w(run, order))
    too_far = F.lit(False) if max_pages is None else F.col(page) - first_page + 1 > max_pages
    marked = marked.withColumn("_closes", (F.col("_end") | too_far) & ~F.col("_start")).withColumn("_far", too_far)
    marked = marked.withColumn("_closed", F.coalesce(F.max(F.col("_closes").cast("int")).over(_w(run, order, before=True)), F.lit(0)) == 1)
    inside = ~F.col("_closed") & ~F.col("_far")
    if first_only:
        over = F.coalesce(F.max(F.col("_closes").cast("int")).over(_w(keys, order, before=True)), F.lit(0)) == 1
        marked = marked.withColumn("_over", over).where("not _over").drop("_over")
    kept = inside & F.when(F.col("_start"), F.lit(include_start)).when(F.col("_end"), F.lit(include_end)).otherwise(True)
    return marked.where(kept).drop("_start", "_end", "_open", "_closes", "_closed", "_far")


def region_pages(rows: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page): the pages of a region's rows, by which a scan is pruned."""
    return rows.select(doc, page).distinct()
