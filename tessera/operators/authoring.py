"""Authoring: rules that are tried against what they must reproduce, samples and evidence levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repaired(candidates: DataFrame, targets: DataFrame, field: str, rank: str, output: str, target: str) -> DataFrame:
    """(field, source, rank): the first candidate rule of a field whose output is the target, `label` where none is but a text behind a label is, else dropped.

    candidates has a row for each field and rule, with kind rule or label.
    """
    hit = candidates.join(targets.select(field, target), field).where(F.lower(F.trim(F.col(output))) == F.lower(F.trim(F.col(target))))
    order = F.struct((F.col("kind") != "rule").cast("int").alias("k"), F.col(rank).alias("r"))
    best = hit.groupBy(field).agg(F.min_by(F.struct("kind", rank), order).alias("b"))
    out = targets.select(field).join(best, field, "left")
    return out.select(field, F.coalesce("b.kind", F.lit("dropped")).alias("source"), F.col(f"b.{rank}").alias(rank))


def hinted(rules: DataFrame, hints: DataFrame, field: str, columns: list[str]) -> DataFrame:
    """Rules with what hints say of their field in place of their own; hints for unknown fields are ignored."""
    h = hints.select(field, *[F.col(c).alias(f"_{c}") for c in columns])
    return rules.join(h, field, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def rounds(attempts: DataFrame, model: str, attempt: str, matched: Column, *, most: int = 3) -> DataFrame:
    """(model, tries, state): a model is saved at the first of its first `most` attempts that matches all documents, else it fails; later attempts are not made."""
    per = attempts.where(F.col(attempt) <= most).groupBy(model, attempt).agg(F.every(matched).alias("ok"))
    out = per.groupBy(model).agg(F.min(F.when(F.col("ok"), F.col(attempt))).alias("at"), F.max(attempt).alias("last"))
    return out.select(model, F.coalesce("at", "last").alias("tries"), F.when(F.col("at").isNotNull(), "saved").otherwise("failed").alias("state"))


def sample_then_replay(sampled: DataFrame, replayed: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(doc, verified): whether a document's rows on the sampled pages are among those that the rules give for all pages, as often."""
    a = sampled.groupBy(doc, *columns).agg(F.count("*").alias("_want"))
    b = replayed.groupBy(doc, *columns).agg(F.count("*").alias("_have"))
    both = a.join(b, [doc, *columns], "left").withColumn("_ok", F.coalesce(F.col("_have") >= F.col("_want"), F.lit(False)))
    return both.groupBy(doc).agg(F.every("_ok").alias("verified"))


def evidence_level(samples: Column, verified: Column, linked: Column) -> Column:
    """How well a discovery is supported: strong with two verified samples, fair with one or with a linked document, else weak."""
    return F.when((samples >= 2) & (verified >= 2), "strong").when((verified >= 1) | linked, "fair").otherwise("weak")


def merged_drafts(draft: DataFrame, profile: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """A profile with a draft's fields merged in: the draft's value goes first, a field that only one of them has stays."""
    d = draft.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return profile.join(d, key, "full").select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def session_log(turns: DataFrame, session: str, order: str, kind: str) -> DataFrame:
    """(session, turns, extractions, last_preview): a session by its turns; a preview counts only if no extraction came after it."""
    w = Window.partitionBy(session)
    last = F.max(F.when(F.col(kind) == "extract", F.col(order))).over(w)
    marked = turns.withColumn("_last", last)
    return marked.groupBy(session).agg(F.count("*").alias("turns"), F.count_if(F.col(kind) == "extract").alias("extractions"), F.max(F.when((F.col(kind) == "preview") & (F.col(order) > F.coalesce("_last", F.lit(-1))), F.col(order))).alias("last_preview"))


def chunk_retries(results: DataFrame, chunk: str, size: str, ok: Column) -> DataFrame:
    """The chunks of the next round: a failed one of two rows and more in two halves, of one row it is given up; done ones stay out."""
    left = results.where(~ok).withColumn("half", F.explode(F.when(F.col(size) > 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("lost")))))
    n = F.when(F.col("half") == "a", F.expr(f"{size} div 2")).when(F.col("half") == "b", F.expr(f"{size} - {size} div 2")).otherwise(F.col(size))
    return left.select(chunk, "half", n.alias(size))


def prompt(parts: list[tuple[str, Column]]) -> Column:
    """A text of titled parts in order; parts without text are left out."""
    return F.concat_ws("\n\n", *[F.when(F.trim(c) != "", F.concat(F.lit(f"## {title}\n"), F.trim(c))) for title, c in parts])
