"""Object tables: Parquet folders named by application group, application and object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.operators.checks import require_count
from tablewright.operators.ranking import first_rows

# Every append lands in its own sub-folder, named by this partition column, which no frame may have.
LOAD = "tablewright_load"


@dataclass(frozen=True)
class ObjectTable:
    """Name of an object table under a root that the whole cluster reaches."""

    root: str
    group: str
    application: str
    name: str

    def __post_init__(self) -> None:
        for part in (self.group, self.application, self.name):
            if not part or "/" in part or "=" in part:
                raise ValueError(f"bad table name part: {part!r}")

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.group}/{self.application}/{self.name}"

    def load_path(self, load: str) -> str:
        return f"{self.path}/{LOAD}={load}"


def read_object(spark: SparkSession, table: ObjectTable, schema: T.StructType | None = None,
                load: str | None = None) -> DataFrame:
    """The whole table, or just one load of it (only that folder is listed and read).

    Without a ``schema`` the columns of all loads are merged; a column that a load lacks is NULL
    there.
    """
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    if load is not None:
        return reader.parquet(table.load_path(load))
    return reader.parquet(table.path).drop(LOAD)


def read_rows(spark: SparkSession, table: ObjectTable, n: int, schema: T.StructType | None = None) -> DataFrame:
    """``n`` rows of the table; raises when it holds fewer.

    The count comes from file footers, and the rows are not gathered into one task.
    """
    df = read_object(spark, table, schema)
    require_count(n, min(n, df.count()))
    return first_rows(df, n)
