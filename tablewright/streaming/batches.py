"""Batch folders applied to a table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.feeds import FeedSpec
from tablewright.plans.apply import apply_feed
from tablewright.sources.objects import ObjectTable
from tablewright.sources.text import feed_rows, feed_scan


def follow_feed(spark: SparkSession, path: str, table: ObjectTable, spec: FeedSpec, schema: T.StructType, checkpoint: str,
                operations: bool = False, order: tuple[str, ...] = (), name: str = "feed", files_per_round: int | None = None,
                forever: bool = False) -> StreamingQuery:
    """Read the folders of ``write_feed_csv`` as a stream and apply each round's rows.

    The epoch is stored with the state it made, so a round that is repeated after a failure
    changes nothing. ``checkpoint`` is a folder of this stream alone. Without ``forever`` the
    stream ends when it has read all there is. New rows of standard objects are numbered round
    by round.
    """
    reader = spark.readStream if files_per_round is None else spark.readStream.option("maxFilesPerTrigger", files_per_round)
    rows = feed_rows(feed_scan(reader, path, schema, operations), spec, operations)

    def apply(df: DataFrame, epoch: int) -> None:
        apply_feed(df, table, spec, order, stream=(name, epoch))

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer if forever else writer.trigger(availableNow=True)).start()
