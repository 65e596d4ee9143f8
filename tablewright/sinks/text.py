"""CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.feeds import FeedSpec, file_name

# Quotes are doubled and blanks kept, as other tools write and read CSV.
QUOTING = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# What a reader sees in place of a quoted empty cell, so that it can tell it from a missing one.
EMPTY = "\x01empty\x01"


def _refusing(df: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """The same rows; a text cell that a reader would take for a marker fails the job."""
    cells = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            refused = F.raise_error(F.lit(f"a cell of {field.name!r} is the text that stands for a missing or empty one"))
            cell = F.when(cell.isin(*markers), refused).otherwise(cell).alias(field.name)
        cells.append(cell)
    return df.select(*cells)


def write_csv(df: DataFrame, path: str, mode: str = "append", missing: str | None = None, parts: int | None = None) -> None:
    """CSV with a header row, as many parts as the frame has partitions, or ``parts``.

    ``mode`` is ``append`` to add parts or ``overwrite`` to replace what is there. NULL is an
    empty cell, or ``missing`` where given; empty text is a quoted empty cell, so ``read_csv``
    returns both as they were. A text that is equal to ``missing`` could not be told from NULL
    and is refused. Text with line breaks is quoted and needs ``multiline`` to be read. ``parts``
    gathers rows in so many tasks: one part is for summaries that an aggregate has made small.
    """
    df = _refusing(df, (EMPTY,) if missing is None else (EMPTY, missing))
    writer = (df if parts is None else df.coalesce(parts)).write.mode(mode).options(**QUOTING)
    writer.option("nullValue", missing or "").option("emptyValue", '""').csv(path)


def write_feed_csv(feed: DataFrame, path: str, spec: FeedSpec, mode: str = "overwrite", operations: bool = False,
                   gather: bool = False) -> None:
    """One folder per batch, ``file={object}_{rows}_{000}``, without ``batch`` and ``op``.

    ``operations`` keeps ``op`` as the last column. A generated feed comes in the order of its
    batches: there are at most as many files as batches and tasks together, and nothing is
    shuffled. Say ``gather`` for a feed in no such order, which has rows of every batch in
    every task: its rows are range-partitioned by batch first. ``read_feed_csv`` reads it back.
    """
    if "file" in feed.columns:
        raise ValueError("'file' is the name of the batches' folders")
    if gather:
        feed = feed.repartitionByRange("batch", F.xxhash64(*[F.col(f"`{c}`") for c in feed.columns]))
    columns = [c for c in feed.columns if c not in ("batch", "op")] + (["op"] if operations else [])
    named = _refusing(feed, (EMPTY,)).withColumn("file", file_name(F.col("batch"), spec))
    writer = named.select(*[F.col(f"`{c}`") for c in columns], "file").write.mode(mode).partitionBy("file")
    writer.options(**QUOTING).option("nullValue", "").option("emptyValue", '""').csv(path)
