"""Change feeds of orders, one query per object type, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.feeds import (
    FeedSpec,
    ObjectType,
    batch_by_ranges,
    batch_counts,
    change_feed,
    require_pool,
)
from tablewright.operators.filters import pool_head
from tablewright.plans.queries.registry import query, table
from tablewright.plans.queries.storage import fact_sql
from tablewright.session import scratch_path
from tablewright.schemas import FACT_FLAG, FACT_RANGES
from tablewright.sinks.text import write_feed_csv
from tablewright.sources.facts import generate_feed
from tablewright.sources.text import read_feed_csv

# Order keys count up from 0, so they serve as the index and stay in the feed as data.
INDEX = "o_orderkey"
INDEXED = {"start": 0, "keep_index": True}

# The batches a pool of orders is cut into, as index ranges: an independent route to the feed.
SLOTS_SQL = """
    p AS (SELECT count(*) - 4 * (count(*) * 2 // 13) AS r, count(*) * 2 // 13 AS i FROM orders),
    q AS (SELECT r, i, r - i AS u, CAST(range AS INTEGER) AS k FROM p, range(5)),
    slots AS (
      SELECT 0 AS batch, 'I' AS op, 1 AS lo, r AS hi FROM p
      UNION ALL SELECT k, 'I', r + (k - 1) * i + 1, r + k * i FROM q WHERE k >= 1
      UNION ALL SELECT k, 'U', r + (k - 1) * i - u + 1, r + (k - 1) * i FROM q WHERE k >= 1),
    pool AS (SELECT o_orderkey + 1 AS ix, * FROM orders),
    placed AS (SELECT pool.*, batch, op FROM pool JOIN slots ON ix BETWEEN lo AND hi)
"""
_PLAIN = "o_orderkey, o_custkey, o_totalprice"
_SHIFTED = """
    CASE WHEN op = 'I' AND batch > 0 THEN o_orderkey + 1 ELSE o_orderkey END AS o_orderkey,
    CASE WHEN op = 'I' AND batch > 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
    CASE WHEN op = 'U' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice"""


def pool_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def order_spec(spark: SparkSession, folder: str, kind: ObjectType | str,
               keys: tuple[str, ...] = ("o_orderkey", "o_custkey")) -> FeedSpec:
    rows = table(spark, folder, "orders").count()
    options = {"candidate_keys": keys} if ObjectType(kind).has_candidate_key else {}
    return FeedSpec.fitting(rows, "sales", kind, amount="o_totalprice", **options)


def order_feed(spark: SparkSession, folder: str, kind: ObjectType | str, **options) -> DataFrame:
    return change_feed(pool_of_orders(spark, folder), INDEX, order_spec(spark, folder, kind, **options), **INDEXED)


def _type_sql(kind: ObjectType) -> str:
    if kind is ObjectType.STANDARD:
        cells = f"{_PLAIN}, CASE WHEN op = 'I' THEN '' ELSE CAST(ix AS VARCHAR) END AS sales_id"
    elif kind.has_external_id:
        cells = f"{_PLAIN}, concat('ext_', ix) AS sales_external_id"
    else:
        cells = _SHIFTED
    return f"WITH {SLOTS_SQL} SELECT {cells}, batch, op FROM placed"


def _register(kind: ObjectType) -> None:
    @query(f"feed_{kind.value}", _type_sql(kind))
    def feed(spark: SparkSession, folder: str) -> DataFrame:
        return order_feed(spark, folder, kind)


for _kind in ObjectType:
    _register(_kind)


@query(
    "feed_batch_counts",
    f"""
    WITH {SLOTS_SQL} SELECT batch, op, count(*) AS "rows" FROM placed GROUP BY batch, op
    """,
)
def feed_batch_counts(spark: SparkSession, folder: str) -> DataFrame:
    return batch_counts(order_feed(spark, folder, ObjectType.STANDARD_WITH_EXTERNAL_ID))


@query(
    "feed_one_batch",
    f"WITH {SLOTS_SQL} SELECT {_SHIFTED}, batch, op FROM placed WHERE batch = 3",
)
def feed_one_batch(spark: SparkSession, folder: str) -> DataFrame:
    """One batch from its two index ranges, stacked by name."""
    spec = order_spec(spark, folder, ObjectType.INCREMENTAL_SNAPSHOT)
    return batch_by_ranges(pool_of_orders(spark, folder), INDEX, spec, 3, **INDEXED)


@query(
    "feed_pool",
    """
    WITH p AS (SELECT count(*) - 4 * (count(*) * 2 // 13) AS r, count(*) * 2 // 13 AS i FROM orders)
    SELECT (SELECT r + 4 * i FROM p) AS pool_rows, (SELECT r FROM p) AS seed_rows,
           count(*) AS seed_found, CAST(sum(o_orderkey) AS BIGINT) AS seed_keys
    FROM orders WHERE o_orderkey < (SELECT r FROM p)
    """,
)
def feed_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The pool holds every index once; its head is the seed batch."""
    pool = pool_of_orders(spark, folder)
    spec = order_spec(spark, folder, ObjectType.STANDARD)
    known = require_pool(pool, INDEX, spec, start=0)
    return pool_head(pool, INDEX, spec.rows_per_batch, start=0).agg(
        F.lit(known).cast("long").alias("pool_rows"),
        F.lit(spec.rows_per_batch).cast("long").alias("seed_rows"),
        F.count(F.lit(1)).alias("seed_found"),
        F.sum("o_orderkey").alias("seed_keys"),
    )


@query(
    "feed_files",
    f"""
    WITH {SLOTS_SQL}
    SELECT batch, count(*) AS "rows", count(*) FILTER (WHERE op = 'I') AS blank_ids, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM placed GROUP BY batch
    """,
)
def feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The feed as one CSV folder per numbered batch, read back."""
    spec = order_spec(spark, folder, ObjectType.STANDARD)
    feed = change_feed(pool_of_orders(spark, folder), INDEX, spec, **INDEXED)
    path = scratch_path(spark, "feed")
    write_feed_csv(feed, path, spec, gather=True)
    return read_feed_csv(spark, path, spec, feed.schema).groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("sales_id") == "").alias("blank_ids"),
        F.sum("o_orderkey").alias("key_sum"),
    )


def _register_files(kind: ObjectType) -> None:
    @query(f"feed_back_{kind.value}", _type_sql(kind))
    def back(spark: SparkSession, folder: str) -> DataFrame:
        """Written as CSV with its operations and read again: the feed."""
        spec, path = order_spec(spark, folder, kind), scratch_path(spark, "feed")
        feed = change_feed(pool_of_orders(spark, folder), INDEX, spec, **INDEXED)
        write_feed_csv(feed, path, spec, operations=True)
        return read_feed_csv(spark, path, spec, feed.schema, operations=True)


# One of each family; the others differ only in how a table takes them.
for _kind in (ObjectType.STANDARD, ObjectType.STANDARD_WITH_EXTERNAL_ID, ObjectType.INCREMENTAL_SNAPSHOT):
    _register_files(_kind)


def _generated_sql(kind: ObjectType) -> str:
    """Facts of the pool's positions, placed by index ranges and shaped as the type prescribes."""
    facts = fact_sql("SELECT ix - 1 AS id, ix, batch, op FROM placed", 3, ", ix, batch, op")
    names = [f'"{c}"' for c in [*FACT_RANGES, FACT_FLAG]]
    if kind is ObjectType.STANDARD:
        cells = [*names, "CASE WHEN op = 'I' THEN '' ELSE CAST(ix AS VARCHAR) END AS sales_id"]
    elif kind.has_external_id:
        cells = [*names, "concat('ext_', ix) AS sales_external_id"]
    else:
        shifts = {'"MARKET_ID"': "op = 'I' AND batch > 0", '"TOTAL_AMOUNT"': "op = 'U'"}
        cells = [f"CASE WHEN {shifts[c]} THEN {c} + 1 ELSE {c} END AS {c}" if c in shifts else c for c in names]
    return f"WITH {SLOTS_SQL} SELECT {', '.join(cells)}, batch, op FROM ({facts})"


def _register_generated(kind: ObjectType) -> None:
    @query(f"feed_generated_{kind.value}", _generated_sql(kind))
    def generated(spark: SparkSession, folder: str) -> DataFrame:
        """As many generated facts as there are orders, as a feed made row by row in the order of its batches."""
        options = {"candidate_keys": ("MARKET_ID",)} if kind.has_candidate_key else {}
        spec = FeedSpec.fitting(table(spark, folder, "orders").count(), "sales", kind, **options)
        return generate_feed(spark, spec, seed=3)


for _kind in (ObjectType.STANDARD, ObjectType.VERSIONED_BITEMPORAL, ObjectType.COMPLETE_SNAPSHOT):
    _register_generated(_kind)
