"""Mean imputation fitted on one part of the rows and applied to all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_means(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> dict[str, float | None]:
    """Mean of every column over the rows that satisfy ``where``: one pass, one result row.

    NaN counts as missing, like NULL. The mean is None when no value is known.
    """
    rows = df if where is None else df.filter(where)
    cells = [F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in columns]
    return rows.agg(*cells).first().asDict()


def fill_means(df: DataFrame, means: Mapping[str, float | None]) -> DataFrame:
    """Put the mean where a value is missing. Columns without a mean carry nothing and are dropped."""
    known = {name: mean for name, mean in means.items() if mean is not None}
    empty = [name for name, mean in means.items() if mean is None]
    filled = {
        name: F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(mean))
        for name, mean in known.items()
    }
    return df.withColumns(filled).drop(*empty)
