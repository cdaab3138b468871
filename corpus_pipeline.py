"""A corpus pipeline of the training-data operators: language, lines, near-duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, which has the columns of
documents; all but the last return these columns.  run() writes each stage's rows as Parquet into the
shared folder and reads them again for the next one.

Odd rows are defined at every stage.  A null or empty text has no language and goes with the first stage; given
to a later one, it has no lines to cut, links with nothing, has size 0 and so is taken or not like any row, and is
placed nowhere.  A null id is a row like others: last among earliest lines, in no group of near-duplicates.  A null source is
a source of its own, a null lang trains nothing, n_chars is only counted anew where lines were cut.  Rows that
repeat an id with the same text are one document from the third stage on, those with other texts are documents
of their own.  Texts of any length are whole throughout.  Ties go to the smaller id, then to the smaller hash of the text.
Columns besides those of documents are left out, whatever their names.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, lines, minhash, mixing, packing
from tessera.llm.common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Least similarity of near-duplicates; with so many tuples a pair at exactly it is missed with probability 2 * (1 - 0.8**2)**11, 1 in 38,000.
PERCENT, TUPLES = 80, 11


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest centroid is near enough; those without letters and those far from all languages go."""
    model = language.train(spark, docs)
    return language.classify(spark, docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line are cut; documents go if lines were cut and none but blank ones is left."""
    cut = lines.dedup(spark, docs.select(*COLUMNS), least=1)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; rows that repeat an id and a text count once, different texts of an id are documents of their own."""
    work = Workspace(spark, "near")
    found = work.put(minhash.near_duplicates(spark, docs, percent=PERCENT, m=TUPLES, by_text=True), "found")
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    gone = found.where("not kept").select("doc_id", "text_key").distinct()
    kept = keyed.join(gone, ["doc_id", "text_key"], "left_anti")
    # keys of which there are several rows: only their rows meet, the other ones stay where they are
    again = work.put(found.where("kept and doc_id is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "text_key"), "again")
    first = F.min(F.struct("lang", "source", "n_chars", "text")).alias("row")
    several = kept.join(again, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(first)
    single = kept.join(again, ["doc_id", "text_key"], "left_anti")
    return single.select(*COLUMNS).union(several.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"row.{c}").alias(c) for c in COLUMNS]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture of sources takes them."""
    return mixing.repeated(mixing.mix(spark, docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' words in training sequences."""
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("lines", drop_repeated_lines),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Language, edit distance and minhash stages have no SQL; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return docs
