"""Volume runs: shape rows, write them to an object table, read them back, time both."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.checks import CountMismatch, fingerprint
from tablewright.operators.shaping import lower_names, reorder
from tablewright.schemas import RUN_STATS
from tablewright.sinks.objects import append_first
from tablewright.sources.objects import ObjectTable, read_object

_LONG = 1 << 63


def timed(action: Callable[[], Any]) -> tuple[Any, float]:
    """Result and seconds of an action. Time actions only: a lazy frame costs nothing yet."""
    started = time.perf_counter()
    result = action()
    return result, time.perf_counter() - started


def geometric_series(spark: SparkSession, first: int, ratio: int, terms: int) -> DataFrame:
    """``term`` 1..terms and ``value`` first * ratio^(term-1)."""
    if terms < 0:
        raise ValueError("terms must not be negative")
    numbers = spark.range(1, terms + 1).select(F.col("id").cast("int").alias("term"))
    if abs(ratio) < 2:
        later = F.lit(first * ratio) if ratio != -1 else F.when(F.col("term") % 2 == 0, -first).otherwise(first)
        return numbers.withColumn("value", F.when(F.col("term") == 1, first).otherwise(later).cast("long"))
    values = [first * ratio**i for i in range(min(terms, 65) if first else 1)]
    if not all(-_LONG <= v < _LONG for v in values):
        raise OverflowError("the series leaves the range of long")
    if not first:
        return numbers.withColumn("value", F.lit(0).cast("long"))
    return spark.createDataFrame(list(enumerate(values, 1)), "term int, value long")


def volume_grid(spark: SparkSession, factor: int = 10, volume_terms: int = 1, frequency_terms: int = 1,
                ratio: int = 2) -> list[tuple[int, int, int]]:
    """(freq, record_count, iteration) of every run, in order."""
    volumes = [r.value * factor for r in geometric_series(spark, 1, ratio, volume_terms).orderBy("term").collect()]
    frequencies = [r.value for r in geometric_series(spark, 1, ratio, frequency_terms).orderBy("term").collect()]
    return [(freq, n, i) for freq in frequencies for n in volumes for i in range(freq)]


def shape_for_store(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower-case the names, then take the listed columns in the case asked for."""
    return reorder(lower_names(df), columns)


@dataclass(frozen=True)
class RoundTrip:
    rows: int
    write_s: float
    read_s: float


def round_trip(df: DataFrame, table: ObjectTable, n: int, load: str | None = None) -> RoundTrip:
    """Append the first ``n`` rows as one load, read that load back, compare content.

    The load is told apart from rows that were in the table before, so lost rows cannot hide
    behind them. Reading goes over every column: that is what the read time measures.
    """
    sent = append_first(df, table, n, load)
    spark = df.sparkSession
    back, read_s = timed(lambda: fingerprint(read_object(spark, table, df.schema, sent.load)))
    if back != sent.fingerprint:
        raise CountMismatch(sent.rows, back.rows, f"rows with fingerprint {sent.fingerprint}")
    return RoundTrip(back.rows, sent.seconds, read_s)


def run_volumes(df: DataFrame, table: ObjectTable, grid: Sequence[tuple[int, int, int]]) -> DataFrame:
    """One round trip per grid cell; one statistics row each."""
    rows, run = [], uuid.uuid4().hex
    for freq, n, iteration in grid:
        trip = round_trip(df, table, n)
        rows.append((run, freq, n, iteration, trip.read_s, trip.write_s))
    return df.sparkSession.createDataFrame(rows, RUN_STATS)
