"""Run statistics: JSON rows, grouped form, long form for a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.schemas import RUN_STATS


def write_stats(stats: DataFrame, path: str) -> None:
    """Append as JSON lines."""
    stats.write.mode("append").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_STATS).json(path)


def grouped_runs(stats: DataFrame) -> DataFrame:
    """Per execution and (freq, record_count), its runs as a list in iteration order.

    An execution repeats a cell ``freq`` times, so that bounds the list, however many
    executions are in the statistics; an iteration beyond it fails the job.
    """
    inside = F.col("iteration").between(0, F.col("freq") - 1)
    entry = F.struct(F.when(inside, F.col("iteration")).otherwise(F.raise_error(F.lit("iteration beyond freq"))).alias("iteration"), "read_s", "write_s")
    return stats.groupBy("run", "freq", "record_count").agg(F.sort_array(F.collect_list(entry)).alias("runs"))


def long_form(stats: DataFrame) -> DataFrame:
    """Two rows per run: (combination, type, time)."""
    pair = F.format_string("(%d, %d)", "freq", "record_count").alias("combination")
    both = F.expr("stack(2, 'Read', read_s, 'Write', write_s) AS (type, time)")
    return stats.select(pair, both)
