"""Reconciliation, tax filling, tax allocation and deliverable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _sum(when: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast(MONEY)


def charge_sums(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: net, tax_rows, fee_rows, line_tax, n_rows of (doc, charge_type, amount, tax_amount)."""
    kind = F.col("charge_type")
    return lines.groupBy(doc).agg(
        _sum(~kind.isin("tax", "fee", "surcharge"), F.col("amount")).alias("net"),
        _sum(kind == "tax", F.col("amount")).alias("tax_rows"),
        _sum(kind.isin("fee", "surcharge"), F.col("amount")).alias("fee_rows"),
        F.coalesce(F.sum("tax_amount"), F.lit(0)).cast(MONEY).alias("line_tax"),
        F.count("*").alias("n_rows"),
    )


def reconciled(documents: DataFrame, sums: DataFrame, *, doc: str = "doc_id", threshold: float = 0.01) -> DataFrame:
    """Documents with computed_total, target, variance, variance_pct (double) and status.

    documents: (doc, subtotal, tax, fees, current_charges, total_due, excluded_total).  Line tax counts if
    its sum is positive, else tax rows, else the stated tax; stated fees stand in for missing fee rows,
    unless they are below the tax where nothing is printed a line.  The nearer of current charges and total
    due, less what is excluded, is the target; a subtotal alone is compared with the net sum.  A target of
    exactly 0 reconciles; none at all is unverifiable.
    """
    zero = F.lit(0).cast(MONEY)
    d = documents.join(sums, doc, "left").fillna(0, ["net", "tax_rows", "fee_rows", "line_tax", "n_rows"])
    per_line = F.col("line_tax") > 0
    stated_fee = F.when((F.col("fee_rows") == 0) & F.col("fees").isNotNull() & (F.col("tax").isNull() | (F.col("fees") > F.col("tax"))), F.col("fees")).otherwise(F.col("fee_rows"))
    other_fee = F.when(F.col("fee_rows") != 0, F.col("fee_rows")).otherwise(F.coalesce("fees", zero))
    small_fee = (F.col("tax_rows") == 0) & (F.col("fee_rows") == 0) & (F.col("fees") > 0) & (F.col("fees") < F.col("tax"))
    fee = F.when(per_line, stated_fee).when(F.coalesce(small_fee, F.lit(False)), zero).otherwise(other_fee)
    tax = F.when(per_line, F.col("line_tax")).when(F.col("tax_rows") != 0, F.col("tax_rows")).otherwise(F.coalesce("tax", zero))
    d = d.withColumn("computed_total", (F.col("net") + tax + fee).cast(MONEY))
    excluded = F.coalesce("excluded_total", zero)
    a, b = (F.col("current_charges") - excluded).cast(MONEY), (F.col("total_due") - excluded).cast(MONEY)
    nearer = F.when(b.isNull() | (a.isNotNull() & (F.abs(F.col("computed_total") - a) <= F.abs(F.col("computed_total") - b))), a).otherwise(b)
    target = F.coalesce(nearer, "subtotal")
    value = F.when(nearer.isNull(), F.col("net")).otherwise(F.col("computed_total"))
    d = d.withColumns({"target": target, "_value": value})
    variance = F.when(F.col("target") == 0, zero).when(F.col("target").isNull(), None).otherwise(F.col("_value") - F.col("target")).cast(MONEY)
    d = d.withColumn("variance", variance)
    share = F.when(F.coalesce(F.col("target"), zero) == 0, 0.0).otherwise(F.abs(F.col("variance").cast("double")) / F.abs(F.when(F.col("target") != 0, F.col("target").cast("double"))))
    d = d.withColumn("variance_pct", share)
    status = F.when(F.col("target").isNull(), "unverifiable").when(F.col("variance_pct") <= threshold, "reconciled").otherwise("mismatch")
    return d.withColumn("status", status).drop("_value")


def rate_filled(lines: DataFrame, rates: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Lines whose missing tax_amount is amount * rate, in documents where every printed one agrees with the rate to 0.01."""
    by_rate = F.round(F.col("amount") * F.col("rate"), 2).cast(MONEY)
    joined = lines.join(rates, doc, "left").withColumn("_by_rate", by_rate)
    agrees = F.every(F.col("tax_amount").isNull() | F.coalesce(F.abs(F.col("tax_amount") - F.col("_by_rate")) <= 0.01, F.lit(False)))
    fits = joined.groupBy(doc).agg((agrees & (F.count("tax_amount") > 0)).alias("_fits"))
    return joined.join(fits, doc).withColumn("tax_filled", F.when(F.col("tax_amount").isNull() & F.col("_fits"), F.col("_by_rate")).otherwise(F.col("tax_amount"))).drop("_by_rate", "_fits", "rate")


def allocated(lines: DataFrame, *, doc: str, order: list[str], amount: str = "cents", total: str = "tax_cents") -> DataFrame:
    """Lines with allocated: the total shared by amount with cumulative rounding, all in cents, so that shares add up.

    The share up to a row is half_up(total * running / sum); a row gets the difference to the row before.
    Signs are allowed; a sum of 0 allocates nothing.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    running = F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(amount).over(Window.partitionBy(doc))
    out = lines.withColumns({"_n": F.col(total) * running, "_d": whole})
    size = F.expr("(2 * abs(_n) + abs(_d)) div (2 * nullif(abs(_d), 0))")
    out = out.withColumn("_share", F.when((F.col("_n") < 0) != (F.col("_d") < 0), -size).otherwise(size))
    return out.withColumn("allocated", F.col("_share") - F.coalesce(F.lag("_share").over(w), F.lit(0))).drop("_n", "_d", "_share")


def tax_plan(documents: DataFrame, lines: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, method): per_line if lines carry tax, allocated if the document states one, rate if it states a rate, else none."""
    some = lines.groupBy(doc).agg((F.coalesce(F.sum("tax_amount"), F.lit(0)) != 0).alias("_some"))
    method = F.when(F.coalesce("_some", F.lit(False)), "per_line").when(F.col("tax") != 0, "allocated").when(F.col("tax_rate") > 0, "rate").otherwise("none")
    return documents.join(some, doc, "left").select(doc, method.alias("method"))


def deliverable(lines: DataFrame) -> DataFrame:
    """Rows to deliver: no tax; fees with a service id; surcharges with one and a tax amount."""
    has_id = F.coalesce(F.col("service_id").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    kind = F.col("charge_type")
    return lines.where(F.when(kind == "tax", False).when(kind == "fee", has_id).when(kind == "surcharge", has_id & F.col("tax_amount").isNotNull()).otherwise(True))


def resequenced(lines: DataFrame, *, doc: str, order: list[str], name: str = "line_number") -> DataFrame:
    return lines.withColumn(name, F.row_number().over(Window.partitionBy(doc).orderBy(*order)).cast("long"))
