"""Train / test splits that depend on the row's key and a seed, on nothing else."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.keyed import check_hash_keys, digest_number, key_digest, share_threshold
from tablewright.operators.ranking import nth_smallest, position_bound

_DIGITS = 15  # hex digits of the digest used for exact sizes: 60 bits


def keyed_split(df: DataFrame, keys: Sequence[str], test_share: float, seed: int,
                column: str = "split") -> DataFrame:
    """Mark each row ``train`` or ``test``. No shuffle; the test share holds on average.

    Rows with equal keys land on the same side, so copies never leak between the sides. A row
    with a NULL key fails the job: all of these would land on one side.
    """
    check_hash_keys(df, keys)
    is_test = F.substring(key_digest(keys, seed), 1, 8) < F.lit(share_threshold(test_share))
    return df.withColumn(column, F.when(_has_keys(keys), _marked(is_test)).otherwise(F.raise_error(F.lit("a row without key cannot be split"))))


def exact_split(df: DataFrame, keys: Sequence[str], test_share: float, seed: int,
                column: str = "split") -> DataFrame:
    """As ``keyed_split`` with exactly ``ceil(test_share * rows)`` test rows.

    The cut-off digest comes from histograms (``nth_smallest``), so marking stays a narrow
    step: nothing is sorted and no window spans the table. When rows that share a key lie
    at the cut, just these are divided by their position; ``df`` should then be a scan with
    narrow steps (see ``first_rows``).
    """
    check_hash_keys(df, keys)
    if not 0.0 < test_share < 1.0:
        raise ValueError("test_share must lie strictly between 0 and 1")
    number = digest_number(key_digest(keys, seed), 1, _DIGITS)
    digests = df.select(number.alias("digest"))
    rows = digests.count()
    target = ceil(Fraction(str(test_share)) * rows)
    if target == 0:
        return df.withColumn(column, F.lit("train"))
    cut, below, at = nth_smallest(digests, "digest", target, low=0, high=16**_DIGITS - 1, scanned=False)
    if below + at == target:
        return df.withColumn(column, _marked(number <= F.lit(cut)))
    tied = df.filter(number == F.lit(cut))
    bound = position_bound(tied, target - below)
    return (
        df.filter(number != F.lit(cut))
        .withColumn(column, _marked(number < F.lit(cut)))
        .unionByName(tied.withColumn(column, _marked(F.monotonically_increasing_id() < F.lit(bound))))
    )


def _has_keys(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def _marked(is_test: Column) -> Column:
    return F.when(is_test, F.lit("test")).otherwise(F.lit("train"))
