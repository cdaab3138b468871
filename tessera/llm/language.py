"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams.  For each language, spherical k-means
over a bounded sample of labelled texts gives several centroids; a text gets the language of the centroid
with the largest cosine.  It is rejected if that cosine is below the language's limit for texts of about as
many different n-grams: longer texts come nearer to their centroids, so a limit for all would let long junk pass.

Document frequencies cover all training rows.  The sample has about `sample` distinct texts a language, and
one at least; equal texts count once in it, so that copies neither fill it nor empty it.  The number of languages
is taken to be small: a model has `per_lang` centroids for each label that occurs.  Texts that are
null or hold no letter are `und`, with score 0, and rejected.  Texts of any length are taken whole.  Of equal
cosines the label first in order wins.  Without any training row, as of an empty table, everything is
`und`.  Other columns are kept by classify(); those named like its own (lang_pred, score, rejected) are replaced.
Null and repeated ids are rows like others; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes as the n-grams see them: ASCII other than letters counts as a space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


#: Languages up to this number go to every task when the sample is picked.
FEW_LANGS = 10_000
#: Classes of texts by their number of different n-grams, in powers of two; rows that a class needs for a limit of its own.
CLASSES, ENOUGH = 16, 12


class Model(NamedTuple):
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # (centroids, dims), rows of length 1
    idf: np.ndarray
    limits: np.ndarray  # (centroids, CLASSES): the least cosine that its language accepts, by size_class()


def grams(text: str, dims: int) -> np.ndarray:
    """Counts of the text's hashed 3-grams of folded UTF-8 bytes."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    if len(b) < 3:
        return np.zeros(dims, np.float32)
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(32 - dims.bit_length() + 1), minlength=dims).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + log count) * idf, of length 1; a row without n-grams stays 0."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for text in b.column(0):
                df += grams(text.as_py() or "", dims) > 0
                n += 1
        some = np.flatnonzero(df)
        yield pa.record_batch({"gram": np.append(some, -1), "df": np.append(df[some], n)})

    return run


def size_class(counts: np.ndarray) -> np.ndarray:
    """The class of each row of n-gram counts: how many binary digits its number of different n-grams has."""
    return np.minimum(CLASSES - 1, np.ceil(np.log2(1 + (counts > 0).sum(axis=1))).astype(np.int64))


def limits_of(cosines: np.ndarray, classes: np.ndarray, quantile: float, slack: float) -> np.ndarray:
    """A limit for each class: slack times the quantile of its cosines, else what the next smaller class has, at the least that of all."""
    out, last = np.zeros(CLASSES), slack * float(cosines.min(initial=1.0))
    for c in range(CLASSES):
        own = cosines[classes == c]
        if len(own) >= ENOUGH:
            last = slack * float(np.quantile(own, quantile))
        out[c] = last
    return out


def _clustered(dims: int, idf: np.ndarray, k: int, quantile: float, slack: float, rounds: int = 12):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("order", kind="stable")
        counts = np.array([grams(t, dims) for t in sample["text"]])
        x = vectors(counts, idf)
        centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
        for _ in range(rounds):
            near = (x @ centers.T).argmax(axis=1)
            for c in range(len(centers)):
                if (near == c).any():
                    centers[c] = x[near == c].sum(axis=0)
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        limits = limits_of((x @ centers.T).max(axis=1), size_class(counts), quantile, slack)
        return pd.DataFrame({"lang": sample["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centers], "limits": limits.astype(np.float64).tobytes()})

    return run


def fit(spark: SparkSession, labelled: DataFrame, *, dims: int = 4096, per_lang: int = 4, sample: int = 600, quantile: float = 0.01, slack: float = 0.6) -> Model:
    """A model from columns text and lang.  What reaches the driver is bounded by dims and the number of languages.

    A language's limit for a class of sizes is `slack` times the `quantile` of its training cosines there.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("order"))
    found = rows.select("text").mapInArrow(_frequencies(dims), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(dims)
    total = 0
    for r in found:
        if r.gram < 0:
            total = r.df
        else:
            df[r.gram] = r.df
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    # a hash bound per language keeps about `sample` distinct texts, found without sorting or gathering a language
    usable = rows.where(F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64("order"), F.lit(1 << 30))
    sizes = usable.select("lang", "order").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least"))
    sizes = Workspace(spark, "languages").put(sizes, "sizes")
    share = (place < F.lit(float(sample << 30)) / F.col("n")) | (place == F.col("least"))
    # a row for each language: where they are few, a join by key would only shuffle all texts by language
    few = sizes.count() <= FEW_LANGS
    picked = usable.join(F.broadcast(sizes) if few else sizes, "lang").where(share).select("lang", "order", "text").dropDuplicates(["lang", "order"])
    groups = picked.groupBy("lang").applyInPandas(_clustered(dims, idf, per_lang, quantile, slack), "lang string, centroid binary, limits binary").collect()
    groups.sort(key=lambda r: (r.lang, r.centroid))
    centroids = np.array([np.frombuffer(r.centroid, np.float32) for r in groups]).reshape(-1, dims)
    return Model([r.lang for r in groups], centroids, idf, np.array([np.frombuffer(r.limits) for r in groups]).reshape(-1, CLASSES))


def _classified(model_of, text_at: int, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_of()
        langs = np.array([*model.langs, UNKNOWN], object)
        for big in batches:
            for b in slices(big, big.schema.names[text_at], 1 << 19):
                texts = b.column(text_at).to_pylist()
                best, score, rejected = np.full(len(texts), len(model.langs)), np.zeros(len(texts)), np.ones(len(texts), bool)
                some = [i for i, t in enumerate(texts) if t and len(model.langs) and _LETTER.search(t)]
                for at in range(0, len(some), 256):
                    part = some[at : at + 256]
                    counts = np.array([grams(texts[i], len(model.idf)) for i in part])
                    cosine = vectors(counts, model.idf) @ model.centroids.T
                    best[part] = cosine.argmax(axis=1)
                    score[part] = np.clip(cosine.max(axis=1), 0, 1)
                    rejected[part] = score[part] < model.limits[best[part], size_class(counts)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs[best], pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*b.schema.names, "lang_pred", "score", "rejected"])

    return run


def classify(spark: SparkSession, docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred, score (cosine, 0 to 1) and rejected."""
    docs = docs.drop(*({"lang_pred", "score", "rejected"} - {text_col}))
    shared = spark.sparkContext.broadcast(tuple(model))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, rejected boolean"])
    return docs.mapInArrow(_classified(lambda: Model(*shared.value), docs.columns.index(text_col)), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: one in four by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """The model of the labelled rows of documents that are not held out."""
    return fit(spark, docs.where(~held_out()).select("text", "lang"))
