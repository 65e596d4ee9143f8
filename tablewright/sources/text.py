"""CSV scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.feeds import FeedSpec, file_name
from tablewright.operators.shaping import with_null_id, with_surrogate_id
from tablewright.session import written
from tablewright.sinks.text import EMPTY, QUOTING


def _restored(df: DataFrame) -> DataFrame:
    """Quoted empty cells as empty text; where a column is not text they are NULL already."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    cells = {c: F.when(F.col(f"`{c}`") == EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) for c in texts}
    return df.select(*[cells.get(c, F.col(f"`{c}`")) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = True,
             missing: str | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header row.

    Give a ``schema`` for anything large: inference reads the whole input once more.
    Without one, ``infer=False`` leaves every column text. An empty cell is NULL and a quoted
    empty one is empty text, unless ``missing`` is given: the marker that stands for no value,
    such as ``NA``, which keeps a number column a number column; all empty cells are empty
    text then. Doubled quotes and blanks are read as written. ``multiline`` allows line breaks
    in quotes; a file is then read by one task, so there should be many.
    """
    reader = spark.read.options(**QUOTING).option("multiLine", multiline)
    if missing is not None:
        reader = reader.option("nullValue", missing).option("emptyValue", "")
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", infer).csv(path)
    if schema is None:
        # Types are inferred with quoted empty cells as missing ones, or numbers would become text.
        schema = reader.option("inferSchema", infer).csv(path).schema
    return _restored(spark.read.options(**QUOTING).option("multiLine", multiline).option("emptyValue", EMPTY).schema(schema).csv(path))


@dataclass(frozen=True)
class Scan:
    """Rows that were read, and lines that could not be."""

    good: DataFrame
    bad: DataFrame


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType, missing: str | None = None,
                   multiline: bool = False, header: bool = True) -> Scan:
    """CSV of a declared schema, lines that do not fit it set apart.

    A line is bad when a cell is not of its column's type or when it has more or fewer cells
    than the schema; a quoted empty cell is no number. ``bad`` has the ``line`` as it stands
    in the ``file``, ``good`` the rows that fit, complete. The input is parsed once and written,
    so both sides together are all lines that were there.
    """
    line, file = "__line", "__file"
    options = {**QUOTING, "header": header, "multiLine": multiline, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": line}
    options |= {"emptyValue": EMPTY} if missing is None else {"nullValue": missing, "emptyValue": ""}
    whole = spark.read.options(**options).schema(T.StructType([*schema.fields, T.StructField(line, T.StringType())])).csv(path)
    parsed = written(whole.withColumn(file, F.input_file_name()), "csv-split")
    good = parsed.filter(F.col(line).isNull()).drop(line, file)
    bad = parsed.filter(F.col(line).isNotNull()).select(F.col(line).alias("line"), F.col(file).alias("file"))
    return Scan(_restored(good) if missing is None else good, bad)


def feed_scan(reader, path: str, schema: T.StructType, operations: bool = False, multiline: bool = False) -> DataFrame:
    """Cells of feed files and their ``file`` folder, through a batch or a stream reader."""
    payload = [f for f in schema.fields if f.name not in ("batch", "op")]
    last = [T.StructField("op", T.StringType())] if operations else []
    whole = T.StructType([*payload, *last, T.StructField("file", T.StringType())])
    return reader.options(**QUOTING).option("multiLine", multiline).option("emptyValue", EMPTY).schema(whole).csv(path)


def feed_rows(scan: DataFrame, spec: FeedSpec, operations: bool = False) -> DataFrame:
    """The feed from ``feed_scan``: blanks restored, ``batch`` from the folder."""
    back = _restored(scan)
    batch = F.substring_index("file", "_", -1).try_cast("int")
    checked = F.when(F.col("file") == file_name(batch, spec), batch).otherwise(
        F.raise_error(F.concat(F.lit("not a batch of this feed: "), F.col("file"))).cast("int")
    )
    payload = [F.col(f"`{c}`") for c in back.columns if c not in ("file", "op")]
    return back.select(*payload, checked.alias("batch"), *(["op"] if operations else []))


def read_feed_csv(spark: SparkSession, path: str, spec: FeedSpec, schema: T.StructType, operations: bool = False,
                  multiline: bool = False) -> DataFrame:
    """A feed as ``write_feed_csv`` wrote it: its columns, ``batch`` and, with ``operations``, ``op``.

    ``schema`` is that of the feed, from which ``batch`` and ``op`` are left out. The batch
    number is that of the folder; a folder of another object or row count fails the job. Blank
    ids come back as blanks and NULL as NULL.
    """
    return feed_rows(feed_scan(spark.read, path, schema, operations, multiline), spec, operations)


def read_csv_for_store(spark: SparkSession, path: str, object_name: str, external_id: bool = False,
                       null_id: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """CSV scan with the id column a store expects in front.

    ``external_id`` adds ``{object}_external_id`` as a surrogate; ``null_id`` adds
    ``{object}_id`` empty, for the store to assign. Snapshots need neither.
    """
    return for_store(read_csv(spark, path, schema), object_name, external_id, null_id)


def for_store(df: DataFrame, object_name: str, external_id: bool = False, null_id: bool = False) -> DataFrame:
    """Rows with the id column a store expects in front, as ``read_csv_for_store`` adds it."""
    if null_id:
        df = with_null_id(df, object_name)
    if external_id:
        df = with_surrogate_id(df, f"{object_name}_external_id")
    return df
