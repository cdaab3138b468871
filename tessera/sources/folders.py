"""Folders of files, from their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(path: Column, depth: int) -> Column:
    """The folders of a path below its scheme, at most `depth` of them; the file's own name is none."""
    parts = F.split(F.regexp_replace(path, r"^[a-z]+://", ""), "/")
    return F.slice(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), 1, depth)


def scanned(files: DataFrame, path: str, *, depth: int = 4) -> DataFrame:
    """(host, folder, files): the first two folders of each file within `depth`, with how many files they hold; a null path is no file."""
    found = files.where(F.col(path).isNotNull()).withColumn("_s", segments(F.split(F.col(path), r"\?")[0], depth))
    return found.groupBy(F.get("_s", F.lit(0)).alias("host"), F.get("_s", F.lit(1)).alias("folder")).agg(F.count("*").alias("files"))
