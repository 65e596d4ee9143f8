"""Aggregates: sizes, means, errors. All combine on the map side before any shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

TOTAL = "all"


def mean_absolute_error(df: DataFrame, prediction: str, target: str, by: str = "split") -> DataFrame:
    """Rows and mean absolute error per split, and for all rows together."""
    gap = F.abs(F.col(prediction) - F.col(target))
    parts = df.groupBy(by).agg(F.count(gap).alias("rows"), F.sum(gap).alias("gap"))
    return _with_total(parts, by, "gap", "mae")


def accuracy(df: DataFrame, prediction: str, target: str, by: str = "split") -> DataFrame:
    """Rows and share of exact matches per split, and for all rows together.

    A prediction that is NULL, or a target that is, counts as wrong.
    """
    hit = F.coalesce((F.col(prediction) == F.col(target)).cast("int"), F.lit(0))
    parts = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(hit).alias("hits"))
    return _with_total(parts, by, "hits", "accuracy")


def observed_accuracy(
    df: DataFrame, prediction: str, target: str, by: str, splits: Sequence[str]
) -> tuple[DataFrame, Callable[[], dict[str, tuple[int, float | None]]]]:
    """Accuracy as a by-product of whatever action the returned frame goes into.

    Rows without a target are not counted. Call the second result after the action: it gives
    (rows, accuracy) for each of the named splits and for all of them together.
    """
    seen = Observation()
    known = F.col(target).isNotNull()
    cells = []
    for i, split in enumerate(splits):
        here = known & (F.col(by) == split)
        cells += [F.count_if(here).alias(f"rows{i}"), F.count_if(here & (F.col(prediction) == F.col(target))).alias(f"hits{i}")]

    def result() -> dict[str, tuple[int, float | None]]:
        found = seen.get
        counts = {split: (found[f"rows{i}"], found[f"hits{i}"]) for i, split in enumerate(splits)}
        counts[TOTAL] = (sum(n for n, _ in counts.values()), sum(h for _, h in counts.values()))
        return {split: (n, h / n if n else None) for split, (n, h) in counts.items()}

    return df.observe(seen, *cells), result


def _with_total(parts: DataFrame, by: str, total: str, name: str) -> DataFrame:
    """Roll the per-split sums up: the rollup sees one row per split, not the data twice."""
    return (
        parts.rollup(by)
        .agg(F.grouping(by).alias("is_total"), F.sum("rows").cast("long").alias("rows"), (F.sum(total) / F.sum("rows")).alias(name))
        .select(F.when(F.col("is_total") == 1, TOTAL).otherwise(F.col(by).cast("string")).alias(by), "rows", name)
    )


def split_shapes(df: DataFrame, by: str = "split", features: Sequence[str] = ()) -> DataFrame:
    """Rows and feature columns of each split."""
    width = len(features) if features else len(df.columns) - 1
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(width))


def class_means(df: DataFrame, by: Sequence[str], columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Rows and rounded column means per group."""
    means = [F.round(F.avg(c), digits).alias(f"avg_{c}") for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *means)
