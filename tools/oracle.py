"""Compare a query's result with that of its oracle SQL, for tests and local runs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

# Spark type names and the SQL type names that hold the same values.
_SAME = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def connect(folder: str):
    """A SQL connection with one view per table of the folder."""
    import duckdb

    duck = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return duck


def compare(df: DataFrame, duck, sql: str | None) -> str | None:
    """None when both agree in columns, types and rows; otherwise what differs."""
    rows = [tuple(row) for row in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    answer = duck.sql(sql)
    names, kinds = list(answer.columns), [str(t) for t in answer.types]
    order = {name: i for i, name in enumerate(names)}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    for field in df.schema.fields:
        kind = kinds[order[field.name]]
        if _SAME.get(field.dataType.simpleString()) != kind:
            return f"type of {field.name}: {field.dataType.simpleString()} against {kind}"
    mine = sorted(rows, key=repr)
    theirs = sorted((tuple(row[order[c]] for c in df.columns) for row in answer.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} against {b}"
    return None
