"""Delivery of documents to named files, batch by batch, in stored tables that can be read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import StoredTable


class Delivery:
    """Files under a path: `documents` has what was delivered, by its key, with the file it is in; `files` says which content has which name.

    The first content of a name keeps it, every further one gets the next number, the same content the same file, in later batches as
    well.  The log of files is written last, as the mark that a batch is there; a batch that comes again, or that broke off
    in between, adds nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.key = key
        self.documents, self.files = StoredTable(spark, f"{path}/documents", [key]), StoredTable(spark, f"{path}/files", ["name", "digest"])

    def deliver(self, rows: DataFrame, batch: str) -> None:
        """Rows (key, name, digest, ...) of one batch."""
        log = self.files.snapshot()
        if batch in log["batches"]:
            return
        first = rows.groupBy("name", "digest").agg(F.min(self.key).alias("_first"))
        none = first.select("name", "digest", F.lit(0).cast("long").alias("n")).limit(0)
        known = self.files.read().select("name", "digest", "n") if log["version"] else none
        last = known.groupBy("name").agg(F.max("n").alias("_last"))
        new = first.join(known, ["name", "digest"], "left_anti").join(last, "name", "left")
        n = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("name").orderBy("_first", "digest"))
        added = new.select("name", "digest", n.cast("long").alias("n"))
        stem, end = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
        file = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("n"), F.lit(")"), end))
        named = rows.join(known.union(added), ["name", "digest"]).withColumn("file", file).drop("n")
        self.documents.merge(named, batch=batch)
        self.files.merge(added, batch=batch, base=log)
