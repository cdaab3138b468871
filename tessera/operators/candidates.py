"""Candidate rows, recovery of missed ones, chunks, routing and model status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def missed(candidates: DataFrame, found: DataFrame, *, doc: str = "doc_id", ident: str = "service_id") -> DataFrame:
    """Candidates whose identifier no found row of the document has; one hit is enough for all with that identifier."""
    return candidates.join(found.select(doc, ident), [doc, ident], "left_anti")


def completeness(candidates: DataFrame, missing: DataFrame, *, doc: str = "doc_id", ident: str = "service_id", most: int = 10) -> DataFrame:
    """(doc, candidates, missing, examples, confidence): the first identifiers missed, and 1 - missing / candidates to 4 decimals."""
    n = candidates.groupBy(doc).agg(F.count("*").alias("candidates"))
    w = Window.partitionBy(doc).orderBy(ident)
    first = missing.withColumn("_n", F.row_number().over(w)).groupBy(doc).agg(F.count("*").alias("missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col(ident)))), ", ").alias("examples"))
    out = n.join(first, doc, "left").fillna(0, ["missing"]).fillna("", ["examples"])
    return out.withColumn("confidence", F.round(1 - F.col("missing") / F.col("candidates"), 4))


def with_defaults(rows: DataFrame, defaults: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows whose null columns are filled from the defaults of their key."""
    named = defaults.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(named, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


#: Rows of a document whose running sums are taken together; sums of blocks are added up apart.
SUMS_BLOCK = 4096


def running_sizes(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, size), seq from 0 without gaps, with end: the sum of sizes up to the row.  Long documents are summed in blocks, so that no task has a whole one."""
    block = F.floor(F.col("seq") / SUMS_BLOCK)
    w = Window.partitionBy("doc_id", "_block").orderBy("seq")
    inner = rows.withColumn("_block", block).withColumn("_inner", F.sum("size").over(w))
    sums = rows.groupBy("doc_id", block.alias("_block")).agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inner.join(sums.withColumn("_before", before).drop("_sum"), ["doc_id", "_block"]).select("doc_id", "seq", "size", (F.col("_inner") + F.col("_before")).alias("end"))


def next_starts(rows: DataFrame, most: int, overlap: int) -> DataFrame:
    """(doc_id, seq, next): if a chunk's first new row is seq, the first new row of the chunk after it; null in the last chunk.

    Such a chunk begins `overlap` rows before seq, and the next one at the first later row with which it would pass `most`.  Running sums
    grow, so that row is found by merging limits with sums in order: within stretches of the sums of `most` each, else at the start of the next stretch.
    """
    sums = running_sizes(rows)
    ahead = F.greatest(F.col("seq") - overlap, F.lit(0))
    base = sums.select("doc_id", F.col("seq").alias("_at"), (F.col("end") - F.col("size")).alias("_base"))
    limits = sums.select("doc_id", "seq", "end", ahead.alias("_at")).join(base, ["doc_id", "_at"]).select("doc_id", "seq", (F.col("_base") + most).alias("value"))
    # a row's own end is no end of its chunk, so the limit is at least that
    limits = limits.join(sums.select("doc_id", "seq", "end"), ["doc_id", "seq"]).select("doc_id", "seq", F.greatest("value", "end").alias("value"), F.lit(1).alias("kind"))
    events = limits.union(sums.select("doc_id", "seq", F.col("end").alias("value"), F.lit(0).alias("kind"))).withColumn("stretch", F.floor(F.col("value") / most))
    # from the largest value down: the last sum met before a limit is the first beyond it; one that equals it is not beyond
    later = Window.partitionBy("doc_id", "stretch").orderBy(*[F.col(c).desc() for c in ("value", "kind", "seq")]).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col("kind") == 0, F.col("seq")), ignorenulls=True).over(later)
    found = events.withColumn("near", near).where("kind = 1")
    firsts = events.where("kind = 0").groupBy("doc_id", "stretch").agg(F.min("seq").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stretches = events.select("doc_id", "stretch").distinct().join(firsts, ["doc_id", "stretch"], "left").withColumn("far", F.last("first", ignorenulls=True).over(w)).select("doc_id", "stretch", "far")
    return found.join(stretches, ["doc_id", "stretch"]).select("doc_id", "seq", F.coalesce("near", "far").alias("next"))


def chunks(rows: DataFrame, most: int, overlap: int) -> DataFrame:
    """(doc_id, chunk, seq): rows (doc_id, seq, size) filled greedily into chunks of `most` (1000 at least); a chunk starts with the last rows of the one before.

    seq counts a document's rows from 0 without gaps; sizes are positive, as a line counts its end.  Every row points to where the chunk after the one that it would begin starts; which rows do begin one is found by
    doubling: after k rounds the pointers span 2**k chunks, and starts are known up to there.  So a document of any length needs as many
    rounds as its number of chunks has binary digits, and no task of its own.
    """
    most = max(1000, most)
    jump = staged(next_starts(rows, most, overlap), "next")
    starts = jump.where("seq = 0").select("doc_id", F.lit(0).cast("long").alias("chunk"), "seq")
    reach, span = jump.where("next is not null"), 1
    while not reach.isEmpty():
        step = starts.join(reach, ["doc_id", "seq"]).select("doc_id", (F.col("chunk") + span).alias("chunk"), F.col("next").alias("seq"))
        starts = staged(starts.union(step), "starts")
        twice = reach.alias("a").join(reach.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.next") == F.col("b.seq"))).select("a.doc_id", "a.seq", "b.next")
        reach, span = staged(twice, "jumps"), span * 2
    w = Window.partitionBy("doc_id").orderBy("chunk")
    bounds = starts.withColumns({"lo": F.greatest(F.col("seq") - overlap, F.lit(0)), "hi": F.lead("seq").over(w)})
    last = rows.groupBy("doc_id").agg(F.max("seq").alias("_last"))
    each = bounds.join(last, "doc_id").select("doc_id", (F.col("chunk") + 1).alias("chunk"), F.explode(F.sequence("lo", F.coalesce(F.col("hi") - 1, F.col("_last")))).alias("seq"))
    return each.select("doc_id", "chunk", "seq")


def routed(documents: DataFrame) -> DataFrame:
    """Documents with path, from profile, has_approved, rules_first and has_candidate: the order of what to run."""
    path = F.when(F.col("profile").isNull(), "ai").when(F.col("has_approved"), "model").when(F.col("rules_first"), "rules_first").when(F.col("has_candidate"), "candidate").otherwise("ai")
    return documents.withColumn("path", path)


def one_approved(models: DataFrame, profile: str, version: str, status: str) -> DataFrame:
    """Models of which only the newest approved one of each profile stays approved; older ones are retired."""
    w = Window.partitionBy(profile, F.col(status) == "approved").orderBy(F.col(version).desc())
    return models.withColumn(status, F.when((F.col(status) == "approved") & (F.row_number().over(w) > 1), "retired").otherwise(F.col(status)))


def delivered_names(files: DataFrame, name: str, digest: str, order: Column) -> DataFrame:
    """Files with delivered: the first content of a name keeps it, another content gets ` (n)`, the same content the same name."""
    per_content = files.groupBy(name, digest).agg(F.min(order).alias("_first"))
    n = F.row_number().over(Window.partitionBy(name).orderBy("_first", digest))
    named = per_content.withColumn("_n", n - 1)
    return files.join(named.drop("_first"), [name, digest]).withColumn("delivered", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_n"), F.lit(")")))).drop("_n")


def safe_name(name: Column) -> Column:
    """A file's stem without characters that file systems refuse, without dots and blanks around it; `output` if nothing is left."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" .")), F.lit("")), F.lit("output"))


def stable_values(rows: DataFrame, keys: list[str], value: str, most: int = 2) -> DataFrame:
    """(keys, value, n, rank): values in at least half of a group's rows (one at least), commonest first, then by value."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    some = n.withColumn("_all", F.sum("n").over(whole)).where(F.col("n") >= F.greatest(F.lit(1), F.expr("_all div 2"))).drop("_all")
    return some.withColumn("rank", F.row_number().over(whole.orderBy(F.col("n").desc(), value)).cast("long")).where(F.col("rank") <= most)


def next_filled(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Rows with the next and the previous text that is not blank."""
    w = Window.partitionBy(*keys).orderBy(order)
    filled = F.nullif(F.trim(text), F.lit(""))
    after = F.first(filled, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"next": after, "previous": F.last(filled, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
