"""Session construction for tests and benchmarks, and the shared scratch folder.

Library functions never build a session: they take the caller's.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_roots: list[str] = []
_scans: dict[str, list[tuple[str, JavaObject]]] = {}  # by application: folders of ``written`` and weak references to their scans


def local_session(cores: str | int = "*", app: str = "tablewright") -> SparkSession:
    """A single-machine session, for tests and bench runs only."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a session of one process may fall
    back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not _local_roots:
        root = tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots.append(root)
    return _local_roots[0]


def _application_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tablewright/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder; two calls never share one."""
    return f"{_application_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote as intermediates.

    Frames that still read them break, so call it once results are consumed or written.
    """
    _delete(spark, _application_scratch(spark))
    _scans.pop(spark.sparkContext.applicationId, None)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_unread(spark: SparkSession, collect: bool = True) -> None:
    """Remove the tables of ``written`` that no frame can read any more.

    Every frame made of such a table holds its scan in the JVM, so a folder goes once the JVM
    has collected the scan, as Spark itself drops the shuffle files of collected frames.
    With ``collect`` both collectors run first.
    """
    if collect:
        gc.collect()
        spark._jvm.System.gc()
    name = spark.sparkContext.applicationId
    unread = [folder for folder, scan in _scans.get(name, []) if scan.get() is None]
    _scans[name] = [(folder, scan) for folder, scan in _scans.get(name, []) if folder not in unread]
    for folder in unread:
        _delete(spark, folder)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative fits a checkpoint folder where the cluster set none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python by about ``BATCH_BYTES`` at a time, unless the session has a bound of its own.

    By Spark's 10,000 rows a batch of texts takes tens of MB outside the heap, in the executor and
    again in each of its Python workers, and neither gives all of it back.
    """
    if spark.conf.get(_BATCH, None) is not None:
        yield
        return
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and scanning it back.

    Unlike a cached frame the result outlives lost executors, and unlike an RDD
    checkpoint it is columnar, so a later count or projection reads only what it needs.
    Earlier tables that no frame reads any more are removed first.
    """
    spark = df.sparkSession
    drop_unread(spark, collect=False)
    path = scratch_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    scan = spark.read.schema(df.schema).parquet(path)
    plan = scan._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":  # else the table stays until drop_scratch
        _scans.setdefault(spark.sparkContext.applicationId, []).append((path, spark._jvm.java.lang.ref.WeakReference(plan.relation())))
    return scan
