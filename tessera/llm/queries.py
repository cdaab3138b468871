"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, clusters, embeddings, language, licenses, lines, media, minhash, mixing, packing, quality, suffix, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.write_media(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.kept_digest(suffix.remove_repeats(spark, _table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark, _table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its id, the digest of what is left, how many lines went, and whether no line is left."""
    cut = lines.dedup(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), least=1, emptied="emptied")
    return cut.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "emptied")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mixing_source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(spark, _table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.classify(spark, docs.select("doc_id", "text"), language.train(spark, docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, _table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(spark, _table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_suffix_array_dedup, op3_warc, op4_line_dedup, op5_embedding_near_dedup, op6_license_scan, op7_best_fit_packing,
        op8_mixing_source_weights, op9_language_id, op10_minhash_near_dedup, op11_cross_tokenizer_alignment, op12_quality_rules, op13_centroid_clustering,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": licenses.oracle_sql(),
    "op8_mixing_source_weights": mixing.ORACLE_SQL,
    "op12_quality_rules": quality.oracle_sql(),
    "op13_centroid_clustering": clusters.oracle_sql(),
}
