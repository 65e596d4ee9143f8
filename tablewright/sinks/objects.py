"""Appending to object tables."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.checks import Fingerprint, as_fingerprint, check_load, check_schema, fingerprint_cells, known_keys, require_count
from tablewright.operators.ranking import first_rows
from tablewright.sources import files
from tablewright.sources.objects import LOAD, ObjectTable, read_object

_SCHEMA = "_tablewright_schema.json"


@dataclass(frozen=True)
class Appended:
    """What one append wrote."""

    load: str
    fingerprint: Fingerprint
    seconds: float

    @property
    def rows(self) -> int:
        return self.fingerprint.rows


def append(df: DataFrame, table: ObjectTable, load: str | None = None, keys: Sequence[str] | None = None,
           schema: T.StructType | None = None, widen: bool = False, whole_table: bool = False) -> Appended:
    """Append the whole frame as one load and check that it arrived.

    Rows are counted and fingerprinted while they are written, so the frame is computed
    once. A job that failed half-way can be run again under the same ``load`` name: it
    replaces that load and cannot append twice. ``keys`` asks for the key check (missing
    or repeated keys raise) before anything is written; with ``whole_table`` keys of the
    table's other loads raise too. The columns must be those of ``schema``, where given, and
    those that the table has; ``widen`` admits new ones.
    """
    if LOAD in df.columns:
        raise ValueError(f"{LOAD!r} is the name of the table's load folders")
    load = load or f"r{uuid.uuid4().hex}"
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", load):
        raise ValueError("a load name is a letter followed by letters, digits, '_' or '-'")
    if schema is not None:
        check_schema(df, schema)
    held = _check_columns(df, table, widen)
    if keys:
        check_load(df, keys)
        if whole_table and held is not None:
            earlier = held.filter(F.col(LOAD) != load)
            clash = known_keys(earlier, df, keys).count()
            if clash:
                raise ValueError(f"{clash} keys are in the table already")
    seen = Observation()
    observed = df.observe(seen, *fingerprint_cells(df.columns))
    started = time.perf_counter()
    observed.write.mode("overwrite").parquet(table.load_path(load))
    seconds = time.perf_counter() - started
    result = Appended(load, as_fingerprint(seen.get), seconds)
    spark = df.sparkSession
    require_count(result.rows, read_object(spark, table, df.schema, load).count(), "rows in the load")
    _keep_schema(df, table)
    return result


def _stored_schema(spark: SparkSession, table: ObjectTable) -> T.StructType | None:
    """The columns of all loads, from a file beside them; tables without it are read once for it."""
    text = files.read_text(spark, f"{table.path}/{_SCHEMA}")
    if text is not None:
        return T.StructType.fromJson(json.loads(text))
    if any(name.startswith(f"{LOAD}=") for name in files.names_in(spark, table.path)):
        return read_object(spark, table).schema
    return None


def _check_columns(df: DataFrame, table: ObjectTable, widen: bool) -> DataFrame | None:
    """Raise when the frame's columns are not those of the table's earlier loads; returns those loads' rows."""
    held = _stored_schema(df.sparkSession, table)
    if held is None:
        return None
    known = {f.name: f.dataType for f in held}
    mine = {f.name: f.dataType for f in df.schema}
    wrong = sorted(n for n in mine if known.get(n, mine[n] if widen else None) != mine[n])
    wrong += [] if widen else sorted(set(known) - set(mine))
    if wrong:
        raise ValueError(f"columns differ from the table's: {wrong}")
    return df.sparkSession.read.schema(T.StructType([*held.fields, T.StructField(LOAD, T.StringType())])).parquet(table.path)


def _keep_schema(df: DataFrame, table: ObjectTable) -> None:
    """Store the table's columns where this load brought new ones."""
    spark = df.sparkSession
    held = _stored_schema(spark, table) or T.StructType()
    whole = T.StructType([*held.fields, *(T.StructField(f.name, f.dataType) for f in df.schema if f.name not in held.names)])
    text = json.dumps(whole.jsonValue())
    if files.read_text(spark, f"{table.path}/{_SCHEMA}") != text:
        files.write_text(spark, f"{table.path}/{_SCHEMA}", text)


def append_first(df: DataFrame, table: ObjectTable, n: int, load: str | None = None) -> Appended:
    """Append the first ``n`` rows; raises when the frame has fewer or another number arrived."""
    result = append(first_rows(df, n), table, load)
    require_count(n, result.rows, "rows written")
    return result
