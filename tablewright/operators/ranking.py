"""Exact 'first n rows' without sending n rows through one task.

``limit(n)`` before a write sends up to n rows of every task into a single one, and
``orderBy(key).limit(n)`` does the same. For large n the cut-off is found first here, from
counts alone, and applied as a plain filter, so the rows never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import written

# Histogram buckets per pass of the cut-off search: the most rows a pass brings back.
BUCKETS = 1 << 16
# Once this few values are left, they are looked at directly.
FEW = 10_000
_LONG_MAX = (1 << 63) - 1


def position_bound(df: DataFrame, n: int) -> int | None:
    """The value below which ``monotonically_increasing_id`` stays for the first ``n`` rows.

    One pass counts rows per partition (from file footers, for whole Parquet files): the
    leading partitions belong to the first rows entirely, one is cut. None when ``df`` has
    no more than ``n`` rows.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("part")).count().collect()
    for part, size in sorted(sizes):  # one small row per partition, never per record
        if size > n:
            return (part << 33) + n
        n -= size
    return None


# Physical operators that leave rows where they are and keep their order.
_NARROW = ("Scan", "LocalTableScan", "Range", "Project", "Filter", "ColumnarToRow", "InputAdapter", "WholeStageCodegen", "Union", "CollectMetrics")


def _is_narrow(df: DataFrame) -> bool:
    """Whether the plan is scans with narrow steps, by the kinds of its nodes."""
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if not node.nodeName().startswith(_NARROW):
            return False
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
    return True


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows (all of them when there are fewer), where they are.

    All but the first ``n`` by position are filtered out; no row moves. Counting and reading
    must see the same partitions, so a frame that is more than a scan with narrow steps is
    written first.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if not _is_narrow(df):
        df = written(df, "first-rows")
    bound = position_bound(df, n)
    if bound is None:
        return df
    position = "__position"
    return df.withColumn(position, F.monotonically_increasing_id()).filter(F.col(position) < bound).drop(position)


def nth_smallest(df: DataFrame, column: str, n: int, low: int | None = None, high: int | None = None,
                 buckets: int = BUCKETS, few: int = FEW, scanned: bool = True) -> tuple[int, int, int]:
    """The n-th smallest value of a whole-number column: ``(value, rows below it, rows at it)``.

    Each pass counts rows in equal slices of the remaining value range (combined on the map
    side) and keeps the slice that holds the n-th row, so 64 bits need at most four passes;
    a slice with few rows is settled in one more. NULLs are left out. ``low`` and ``high``, if
    given, must enclose all values. Say ``scanned=False``
    for a computed column: the first slice chosen is then written, so that later passes do
    not compute the column for all rows again. For a column of the scan the slice is a
    filter, pushed down.
    """
    frame = df.select(F.col(column).cast("long").alias("v"))
    if low is None or high is None:
        low, high = frame.agg(F.min("v"), F.max("v")).first()
    if n < 1 or low is None:
        raise ValueError("n must be at least 1 and the column must hold values")
    below, width = 0, max(1, -(-(high - low + 1) // buckets))
    while True:
        slot_of = _slot(low, high, width)
        rows = frame.filter(F.col("v").between(low, high)) if scanned else frame
        counts = rows.groupBy(slot_of.alias("slot")).count().collect()
        for slot, size in sorted((slot, size) for slot, size in counts if slot is not None):
            if below + size >= n:
                break
            below += size
        else:
            raise ValueError(f"fewer than {n} rows in {column!r}")
        if not scanned and width > 1:
            frame, scanned = written(frame.filter(slot_of == slot), "slice"), True
        low = low + slot * width
        high = min(high, low + width - 1)
        if low == high:
            return low, below, size
        width = 1 if size <= few else max(1, -(-(high - low + 1) // buckets))


def _slot(low: int, high: int, width: int) -> Column:
    """Number of the slice of ``width`` values that ``v`` falls into, for values in the range.

    ``v`` occurs once: where it is a costly expression, it is evaluated once per row.
    """
    exact = "decimal(20,0)" if high - low > _LONG_MAX else "bigint"
    offset = F.col("v").cast(exact) - F.lit(low).cast(exact)
    return F.call_function("div", offset, F.lit(width).cast(exact)).cast("long")


def first_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest values of a whole-number key.

    The cut-off is a literal, so it reaches the scan as a pushed-down filter. When the key
    repeats at the cut-off, any of the tied rows fill the remainder. NULL keys come last. The
    order of the result is not part of it.
    """
    if not isinstance(df.select(key).schema[0].dataType, T.IntegralType):
        raise TypeError("first_by_key needs a whole-number key")
    if n < 1:
        return df.filter(F.lit(False))
    keyed = df.filter(F.col(key).isNotNull())
    known = keyed.count()
    if known <= n:
        rest = n - known
        return keyed if rest == 0 else keyed.unionByName(first_rows(df.filter(F.col(key).isNull()), rest))
    value, below, at = nth_smallest(keyed, key, n)
    if below + at == n:
        return keyed.filter(F.col(key) <= value)
    tied = first_rows(keyed.filter(F.col(key) == value), n - below)
    return keyed.filter(F.col(key) < value).unionByName(tied)


def preview(df: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """``k`` rows in key order, for a look at a table. Top-k heaps per task, no full sort."""
    return df.orderBy(*keys).limit(k)
