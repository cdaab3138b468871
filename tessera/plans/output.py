"""Output specifications: an ordered list of columns with sources, fallbacks and transforms."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


class OutputColumn(NamedTuple):
    header: str
    source: str
    fallback: str | None = None
    transforms: tuple[str, ...] = ()


def project(rows: DataFrame, spec: Sequence[OutputColumn]) -> DataFrame:
    """The columns of the spec; a fallback is taken where the source is null (an empty text is a value)."""
    out = []
    for c in spec:
        value = F.col(c.source) if c.fallback is None else F.coalesce(F.col(c.source), F.col(c.fallback))
        out.append((text.transformed(value, list(c.transforms)) if c.transforms else value).alias(c.header))
    return rows.select(*out)
