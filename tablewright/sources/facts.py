"""Generated fact rows. Every cell is a function of the row id, its column and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.keyed import SLOTS, WORDS, digest_int, uniform_int, with_words
from tablewright.operators.feeds import ROWS_PER_TASK, FeedSpec, feed_slots, shaped
from tablewright.schemas import FACT_FLAG, FACT_FLAG_VALUE, FACT_RANGES


def with_facts(df: DataFrame, row_id: str, seed: int, others: Sequence[str] = ()) -> DataFrame:
    """The 21 fact columns for a 0-based row id, and the columns in ``others``."""
    names = [f"__word{n}" for n in range(WORDS)]
    words, columns = [F.col(n) for n in names], []
    for draw, (name, bounds) in enumerate(FACT_RANGES.items(), start=1):
        cell = F.col(row_id).cast("long") if bounds is None else uniform_int(words, draw, *bounds)
        columns.append(cell.alias(name))
    return with_words(df, row_id, seed, names).select(*columns, F.lit(FACT_FLAG_VALUE).alias(FACT_FLAG), *others)


def with_own_draws(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """The 21 fact columns for a 0-based row id, every drawn cell from digits of its own.

    By ``with_facts`` three measures of a row determine its others. Four columns share a
    digest, of which each has eight digits.
    """
    columns, drawn = [], 0
    for name, bounds in FACT_RANGES.items():
        if bounds is None:
            columns.append(F.col(row_id).cast("long").alias(name))
            continue
        block, slot = divmod(drawn, SLOTS)
        digest = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{block}:{seed}")))
        columns.append(digest_int(digest, slot, *bounds).alias(name))
        drawn += 1
    return df.select(*columns, F.lit(FACT_FLAG_VALUE).alias(FACT_FLAG))


def generate_facts(spark: SparkSession, rows: int, seed: int = 0, partitions: int | None = None, own_draws: bool = False) -> DataFrame:
    """``rows`` fact rows; ``MARKET_ID`` numbers them from 0. With ``own_draws`` no cell follows from others."""
    if rows < 0:
        raise ValueError("rows must not be negative")
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    ids = spark.range(0, rows, 1, partitions)
    return with_own_draws(ids, "id", seed) if own_draws else with_facts(ids, "id", seed)


def generate_feed(spark: SparkSession, spec: FeedSpec, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """The change feed of generated facts, in the order of its batches.

    Every cell follows from the row's number in the feed: nothing is generated that no batch
    holds, and no row is sent to another task.
    """
    slots = feed_slots(spark, spec, partitions)
    facts = with_facts(slots.withColumn("row", F.col("position") - 1), "row", seed, ["batch", "op"])
    return shaped(facts, "MARKET_ID", spec, start=0, keep_index=True)


def facts_for(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Fact rows for the ids in a key column of another table."""
    return with_facts(df, key, seed)
