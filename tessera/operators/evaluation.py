"""Evaluation: scores of runs, routes of documents, rules that reproduce their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_text(a: Column, b: Column) -> Column:
    """Equality in any case, blanks around aside; null equals null only."""
    return F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))


def deliverable_scores(counts: DataFrame, ungrounded: DataFrame, reconciled: DataFrame, doc: str) -> DataFrame:
    """(doc, row_f1, ungrounded, consistent, passed) from counts (doc, matched, missing, extra), cells that no source has, and reconciliation."""
    f1 = 2 * F.col("matched") / F.nullif(2 * F.col("matched") + F.col("missing") + F.col("extra"), F.lit(0))
    out = counts.join(ungrounded, doc, "left").join(reconciled, doc, "left")
    clean = F.coalesce("ungrounded", F.lit(0)) == 0
    return out.select(doc, F.round(F.coalesce(f1, F.lit(1.0)), 4).alias("row_f1"), F.coalesce("ungrounded", F.lit(0)).cast("long").alias("ungrounded"), F.coalesce("consistent", F.lit(False)).alias("consistent"), ((F.col("missing") + F.col("extra") == 0) & clean).alias("passed"))


def suite(cases: DataFrame, types: list[str], result: Column) -> DataFrame:
    """Cases once for each call type, with its result and place in the order of cases and types."""
    each = cases.withColumn("call_type", F.explode(F.array(*map(F.lit, types)))).withColumn("result", result)
    return each


def against_baseline(runs: DataFrame, accepted: str, metric: str) -> DataFrame:
    """Runs with the difference of a metric to the newest accepted run before them."""
    w = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col(accepted), F.col(metric)), ignorenulls=True).over(w)
    return runs.withColumn("delta", F.round(F.col(metric) - base, 6))


def folder_scores(rows: DataFrame, file: str, hit: Column) -> DataFrame:
    """(file, matched, expected, complete) of expected rows and whether each was found."""
    return rows.groupBy(file).agg(F.count_if(hit).alias("matched"), F.count("*").alias("expected"), F.every(hit).alias("complete"))


def verified_rules(candidates: DataFrame, field: str, order: str, output: str, target: str) -> DataFrame:
    """(field, rule): the first of a field's candidate rules whose output equals the target in all its documents; fields without one are dropped."""
    ok = candidates.groupBy(field, order).agg(F.every(same_text(F.col(output), F.col(target)) & F.col(target).isNotNull()).alias("ok"))
    return ok.where("ok").groupBy(field).agg(F.min(order).alias("rule"))


def truth_rows(documents: DataFrame, truths: DataFrame, doc: str, status: str) -> DataFrame:
    """Documents with the status of their ground truth, pending where there is none."""
    return documents.join(truths.select(doc, status), doc, "left").withColumn(status, F.coalesce(status, F.lit("pending")))


def routes(documents: DataFrame, gates: list[tuple[str, Column]], fallback: str = "ai") -> DataFrame:
    """Documents with route: the first gate that they pass, else the fallback."""
    return documents.withColumn("route", F.coalesce(*[F.when(c, F.lit(name)) for name, c in gates], F.lit(fallback)))


def with_fallback(ruled: DataFrame, passed: DataFrame, other: DataFrame, doc: str) -> DataFrame:
    """Rows that rules made for documents that passed the gate, and the other path's rows for those that did not; source tells which."""
    ok = passed.where("passed").select(doc)
    first = ruled.join(ok, doc, "left_semi").withColumn("source", F.lit("rules"))
    return first.unionByName(other.join(ok, doc, "left_anti").withColumn("source", F.lit("ai")))


def side_by_side(authoritative: DataFrame, other: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(doc, matched, missing, extra, credited) of two outputs as multisets of rows: a model is credited where nothing differs."""
    named = {c: f"_{c}" for c in [doc, *columns]}
    a = authoritative.groupBy(doc, *columns).agg(F.count("*").alias("a"))
    b = other.groupBy(doc, *columns).agg(F.count("*").alias("b")).withColumnsRenamed(named)
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]
    both = a.join(b, on, "full").select(F.coalesce(doc, named[doc]).alias(doc), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    sums = both.groupBy(doc).agg(F.sum(F.least("a", "b")).alias("matched"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))
    return sums.withColumn("credited", F.col("missing") + F.col("extra") == 0)


def families(pages: DataFrame, keys: list[str], text: str, words: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """(keys, family, confidence): the family with most of its words in a text, the first of equals; other below `least` words."""
    low = F.lower(F.col(text))
    best = F.array_max(F.array(*[F.struct(sum((low.contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name"), F.lit(len(ws)).alias("of")) for k, (name, ws) in enumerate(words.items())]))
    out = pages.withColumn("_best", best)
    known = F.col("_best.n") >= least
    return out.select(*keys, F.when(known, F.col("_best.name")).otherwise("other").alias("family"), F.when(known, F.round(F.col("_best.n") / F.col("_best.of"), 4)).otherwise(0.0).alias("confidence"))


def conflicts(notes: DataFrame, fields: DataFrame, doc: str, name: str, value: str) -> DataFrame:
    """(doc, name, noted, stated, state): what notes say of fields against their values: agrees, conflicts or missing; a note marked override wins."""
    n = notes.select(doc, name, F.col(value).alias("noted"), "override")
    both = n.join(fields.select(doc, name, F.col(value).alias("stated")), [doc, name], "left")
    state = F.when(F.col("stated").isNull(), "missing").when(same_text(F.col("noted"), F.col("stated")), "agrees").when(F.col("override"), "overridden").otherwise("conflicts")
    return both.select(doc, name, "noted", "stated", state.alias("state"))


def readiness(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows with the names of the checks that they fail, in order, and ready if there are none."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks]))
    return rows.withColumn("failed", F.array_join(failed, ",")).withColumn("ready", F.col("failed") == "")
