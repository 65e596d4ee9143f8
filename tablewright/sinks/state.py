"""Published states of keyed tables.

A state is a set of Parquet folders named by one small pointer file. A new state is written
aside and checked; then its pointer appears under the next version number, by a rename that
cannot be seen half done. Readers take the newest pointer, so they see the old state or the
new one, and a writer that is killed leaves the old state as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from tablewright.operators.checks import as_fingerprint, fingerprint_cells, require_count
from tablewright.sources import files
from tablewright.sources.objects import ObjectTable

_FOLDER = "_tablewright_state"  # a leading underscore keeps it out of scans of the table's loads


class StateConflict(Exception):
    """Another writer published after the state that this one was made from."""


@dataclass(frozen=True)
class State:
    """What a pointer says: version, data folders, rows, schema, and what was applied."""

    version: int
    loads: tuple[str, ...]
    rows: int
    columns: str  # the schema as JSON
    last_batch: int | None = None
    streams: dict[str, int] = field(default_factory=dict)  # last epoch per stream

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.columns))


def _pointers(table: ObjectTable) -> str:
    return f"{table.path}/{_FOLDER}/pointers"


def _data(table: ObjectTable, load: str) -> str:
    return f"{table.path}/{_FOLDER}/data/{load}"


def _pointer(spark: SparkSession, table: ObjectTable, name: str) -> State | None:
    try:
        held = json.loads(files.read_text(spark, f"{_pointers(table)}/{name}") or "")
        return State(**{**held, "loads": tuple(held["loads"])})
    except (ValueError, TypeError, KeyError):  # not a pointer
        return None


def current_state(spark: SparkSession, table: ObjectTable) -> State | None:
    """The newest published state, or None before the first one."""
    names = [n for n in files.names_in(spark, _pointers(table)) if n.endswith(".json") and not n.startswith((".", "_"))]
    for name in reversed(names):
        state = _pointer(spark, table, name)
        if state is not None:
            return state
    return None


def read_state(spark: SparkSession, table: ObjectTable, state: State | None = None) -> DataFrame | None:
    """The rows of ``state``, or of the newest one; None before the first one."""
    state = state or current_state(spark, table)
    if state is None:
        return None
    if not state.loads:
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).parquet(*[_data(table, load) for load in state.loads])


def publish(df: DataFrame, table: ObjectTable, base: State | None, add: bool = False, cluster_by: Sequence[str] = (),
            last_batch: int | None = None, streams: dict[str, int] | None = None, keep: int = 2) -> State:
    """Make ``df`` the table's state; with ``add``, the rows of ``base`` and those of ``df``.

    ``base`` is the state that ``df`` was made from, and must still be the newest when the
    pointer is set. ``cluster_by`` stores rows in ranges of these columns, so that later scans
    skip files by their bounds. Rows are counted while they are written and again in the
    files. The ``keep`` newest states stay readable; folders that only older ones name are
    removed.
    """
    spark = df.sparkSession
    load = uuid.uuid4().hex
    placed = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    seen = Observation()
    placed.observe(seen, *fingerprint_cells(df.columns)).write.parquet(_data(table, load))
    rows = as_fingerprint(seen.get).rows
    require_count(rows, spark.read.schema(df.schema).parquet(_data(table, load)).count(), "rows in the state")
    if add and base is not None:
        if {f.name: f.dataType for f in base.schema} != {f.name: f.dataType for f in df.schema}:
            raise ValueError("the columns are not those of the state")
    loads = (*base.loads, load) if add and base is not None else (load,)
    state = State(
        version=base.version + 1 if base else 1, loads=loads, rows=rows + (base.rows if add and base else 0),
        columns=json.dumps(df.schema.jsonValue()), last_batch=last_batch, streams=streams or {},
    )
    _set_pointer(spark, table, state)
    _forget(spark, table, state.version - keep)
    return state


def _name(version: int) -> str:
    return f"{version:012d}.json"


def _set_pointer(spark: SparkSession, table: ObjectTable, state: State) -> None:
    aside = f"{_pointers(table)}/_{uuid.uuid4().hex}"
    files.write_text(spark, aside, json.dumps(asdict(state)))
    if not files.move_new(spark, aside, f"{_pointers(table)}/{_name(state.version)}"):
        files.delete(spark, aside)
        raise StateConflict(f"version {state.version} of {table.path} was published by another writer")


def _forget(spark: SparkSession, table: ObjectTable, upto: int) -> None:
    """Remove pointers up to a version, then the folders that no other pointer names."""
    names = [n for n in files.names_in(spark, _pointers(table)) if not n.startswith((".", "_"))]
    old = [n for n in names if n <= _name(upto)]
    if not old:
        return
    held = {n: _pointer(spark, table, n) for n in names}
    needed = {load for n in names if n not in old and held[n] for load in held[n].loads}
    for name in old:
        files.delete(spark, f"{_pointers(table)}/{name}")
    for load in {load for n in old if held[n] for load in held[n].loads} - needed:
        files.delete(spark, _data(table, load))
