"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.session import written

ROWS_PER_BATCH = 2_000
WHITE_SPACE = b" \t\n\x0b\x0c\r"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once per application; their Python imports it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tablewright-ship-")
    target = Path(folder, "tablewright_library.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of ``text``; null counts as empty, other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(cast(text as binary), X'')").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered_texts(docs: DataFrame) -> DataFrame:
    """row, doc_id and the UTF-8 bytes of ``text``, written once: the number tells rows of one doc_id apart."""
    return written(whole_texts(docs).withColumn("row", F.monotonically_increasing_id()), "texts")


def numbered(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` written with a number per row, that column's name, and their ``row``, ``doc_id``, ``text``."""
    name = unused(docs, "_row")
    docs = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    texts = docs.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(cast(text as binary), X'')").alias("text"))
    return docs, name, texts


def held_out(id_column: str, remainder: int) -> Column:
    """Rows whose crc32(id as text) mod 5 is ``remainder``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == remainder


def mapped(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[tuple]], schema: str, at_once: int | None = None) -> DataFrame:
    """``rows`` turns the batches of a partition, as dicts of columns, into tuples of ``schema``.

    Tuples are sent back in batches of at most ``ROWS_PER_BATCH`` rows and about 16 MB. With
    ``at_once`` no more rows than that are Python objects at a time, however large Spark's
    batches are.
    """
    ship(df.sparkSession)
    empty = StructType.fromDDL(schema)
    names, kinds = [f.name for f in empty], [_arrow(f.dataType.simpleString()) for f in empty]
    fields = pa.schema(list(zip(names, kinds)))

    def run(batches):
        held, size = [], 0
        parts = batches if at_once is None else (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once))
        for row in rows({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in parts):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
            if len(held) >= ROWS_PER_BATCH or size >= 16 << 20:
                yield _batch(held, fields)
                held, size = [], 0
        if held:
            yield _batch(held, fields)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Return free memory to the machine: a Python worker lives on, beside the JVM, through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped_arrays(df: DataFrame, arrays: Callable[[Iterator[dict]], Iterable[list]], schema: str, at_once: int = 256) -> DataFrame:
    """As ``mapped``, but ``arrays`` yields columns: lists of numpy arrays, a whole batch each."""
    ship(df.sparkSession)
    empty = StructType.fromDDL(schema)
    fields = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in empty])

    def run(batches):
        parts = (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once))
        for columns in arrays({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in parts):
            whole = [pa.array(c, t) for c, t in zip(columns, fields.types)]
            for at in range(0, len(whole[0]), 50_000):
                yield pa.record_batch([c.slice(at, 50_000) for c in whole], schema=fields)
        _give_back()

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), fields.types)], schema=fields)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "binary": pa.binary(), "boolean": pa.bool_(),
    }[kind]
