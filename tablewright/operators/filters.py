"""Row filters and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is known."""
    return df.na.drop(subset=[label])


def index_between(df: DataFrame, index: str, first: int, last: int) -> DataFrame:
    """Rows with an index in the inclusive range; empty when ``last < first``.

    A contiguous id list is a range, so this is two pushed-down comparisons instead of
    membership in a list that grows with the data.
    """
    return df.filter(F.col(index).between(first, last))


def pool_head(df: DataFrame, index: str, n: int, start: int = 1) -> DataFrame:
    """The first ``n`` rows of a pool whose index counts up from ``start``."""
    return df.filter(F.col(index) < start + n)


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Union-all by column name; a column one frame lacks is NULL there."""
    if not frames:
        raise ValueError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
