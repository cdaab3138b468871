"""Values that an expression names more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(df: DataFrame, name: str) -> DataFrame:
    """The rows with a column that is worked out once, though rows are then chosen by it; a filter on a plain column would work it out for itself, too."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(name)).alias(name)).select(*df.columns)
