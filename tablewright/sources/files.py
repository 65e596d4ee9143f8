"""Small files beside tables, on any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    name, store = _open(spark, path)
    return store.exists(name)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none when it does not exist."""
    name, store = _open(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(name)) if store.exists(name) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None when there is none."""
    name, store = _open(spark, path)
    if not store.exists(name):
        return None
    stream = store.open(name)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write the file, replacing one that is there."""
    name, store = _open(spark, path)
    stream = store.create(name, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def move_new(spark: SparkSession, path: str, target: str) -> bool:
    """Rename a file to a name that must be free; False when it is taken."""
    name, store = _open(spark, path)
    goal = _open(spark, target)[0]
    return not store.exists(goal) and store.rename(name, goal)


def delete(spark: SparkSession, path: str) -> None:
    name, store = _open(spark, path)
    store.delete(name, True)
