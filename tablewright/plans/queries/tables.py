"""Applying a feed of orders to keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.feeds import FeedSpec, ObjectType
from tablewright.operators.tables import (
    append_rows,
    assign_ids,
    classify,
    merge_snapshot,
    replace_snapshot,
    upsert,
    versions,
)
from tablewright.plans.apply import apply_feed
from tablewright.plans.queries.feeds import SLOTS_SQL, order_feed, order_spec
from tablewright.plans.queries.registry import query, table
from tablewright.session import scratch_path
from tablewright.sinks.state import read_state
from tablewright.sinks.text import write_feed_csv
from tablewright.sources.objects import ObjectTable
from tablewright.sources.text import read_feed_csv
from tablewright.streaming.batches import follow_feed

_SHIFTED_KEY = "CASE WHEN op = 'I' AND batch > 0 THEN o_orderkey + 1 ELSE o_orderkey END"
_RAISED = "CASE WHEN op = 'U' THEN o_totalprice + 1 ELSE o_totalprice END"
_BY_KEY = {"keys": ("o_orderkey",)}


@query(
    "object_transactional",
    f"""
    WITH {SLOTS_SQL}
    SELECT {_SHIFTED_KEY} AS o_orderkey, o_custkey, {_RAISED} AS o_totalprice, batch, op FROM placed
    UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, CAST(NULL AS INTEGER), NULL FROM orders
    """,
)
def object_transactional(spark: SparkSession, folder: str) -> DataFrame:
    """Every row is kept: the table's own and the feed's."""
    held = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return append_rows(held, order_feed(spark, folder, ObjectType.STANDARD_TRANSACTIONAL, **_BY_KEY))


_UPSERT_SQL = f"""
    WITH {SLOTS_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY ix ORDER BY batch DESC) AS rn FROM placed)
    SELECT o_orderkey, o_custkey, o_totalprice, concat('ext_', ix) AS sales_external_id, batch, op
    FROM ranked WHERE rn = 1
"""


@query("object_upsert", _UPSERT_SQL)
def object_upsert(spark: SparkSession, folder: str) -> DataFrame:
    feed = order_feed(spark, folder, ObjectType.STANDARD_WITH_EXTERNAL_ID)
    return upsert(None, feed, ["sales_external_id"])


@query("object_upsert_next_batch", _UPSERT_SQL)
def object_upsert_next_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The last batch applied to the table the earlier ones made."""
    feed = order_feed(spark, folder, ObjectType.STANDARD_WITH_EXTERNAL_ID)
    table_so_far = upsert(None, feed.filter(F.col("batch") < 4), ["sales_external_id"])
    return upsert(table_so_far, feed.filter(F.col("batch") == 4), ["sales_external_id"], follows=True)


_ASSIGNED_SQL = f"""
    WITH {SLOTS_SQL}, born AS (
      SELECT o_orderkey AS k, row_number() OVER (ORDER BY batch, o_orderkey) AS new_id FROM placed WHERE op = 'I'),
    rows_with_id AS (
      SELECT placed.*, CASE WHEN op = 'I' THEN new_id ELSE ix END AS sales_id
      FROM placed JOIN born ON k = o_orderkey),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sales_id ORDER BY batch DESC) AS rn FROM rows_with_id)
    SELECT o_orderkey, o_custkey, o_totalprice, CAST(sales_id AS BIGINT) AS sales_id, batch, op
    FROM ranked WHERE rn = 1
"""


@query("object_assign_ids", _ASSIGNED_SQL)
def object_assign_ids(spark: SparkSession, folder: str) -> DataFrame:
    return assign_ids(None, order_feed(spark, folder, ObjectType.STANDARD), "sales_id", ["o_orderkey"])


_REPLACED_SQL = f"""
    WITH {SLOTS_SQL}
    SELECT {_SHIFTED_KEY} AS o_orderkey, o_custkey, {_RAISED} AS o_totalprice, batch, op
    FROM placed WHERE batch = (SELECT max(batch) FROM placed)
"""


@query("object_replace", _REPLACED_SQL)
def object_replace(spark: SparkSession, folder: str) -> DataFrame:
    return replace_snapshot(order_feed(spark, folder, ObjectType.COMPLETE_SNAPSHOT, **_BY_KEY))


_MERGED_SQL = f"""
    WITH {SLOTS_SQL}, keyed AS (
      SELECT {_SHIFTED_KEY} AS key, o_custkey, {_RAISED} AS price, batch, op FROM placed),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY batch DESC) AS rn FROM keyed)
    SELECT key AS o_orderkey, o_custkey, price AS o_totalprice, batch, op FROM ranked WHERE rn = 1
"""


@query("object_merge", _MERGED_SQL)
def object_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Shifted insert keys meet their neighbours' keys here, as the feed sends them; the newest wins."""
    feed = order_feed(spark, folder, ObjectType.INCREMENTAL_SNAPSHOT, **_BY_KEY)
    return merge_snapshot(None, feed, ["o_orderkey"])


_VERSIONS_SQL = f"""
    WITH {SLOTS_SQL}
    SELECT o_orderkey, o_custkey, o_totalprice, concat('ext_', ix) AS sales_external_id, batch, op,
           batch AS valid_from, lead(batch) OVER (PARTITION BY ix ORDER BY batch) AS valid_to
    FROM placed
"""


@query("object_versions", _VERSIONS_SQL)
def object_versions(spark: SparkSession, folder: str) -> DataFrame:
    feed = order_feed(spark, folder, ObjectType.STANDARD_BITEMPORAL)
    return versions(feed, ["sales_external_id"], batches=5, unique=True)


@query("object_versions_in_pieces", _VERSIONS_SQL)
def object_versions_in_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """As ``object_versions`` when the number of batches is not known: a key's rows in bounded pieces."""
    feed = order_feed(spark, folder, ObjectType.VERSIONED_BITEMPORAL)
    return versions(feed, ["sales_external_id"], piece=2)


@query(
    "feed_classify",
    f"""
    WITH {SLOTS_SQL}
    SELECT o_orderkey, o_custkey, o_totalprice, batch,
           CASE WHEN batch = min(batch) OVER (PARTITION BY ix) THEN 'I' ELSE 'U' END AS op
    FROM placed
    """,
)
def feed_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Recover the operation from keys and batches alone."""
    feed = order_feed(spark, folder, ObjectType.STANDARD_WITH_EXTERNAL_ID).drop("op")
    return classify(feed, ["sales_external_id"]).drop("sales_external_id")


@query(
    "lines_classify",
    """
    WITH m AS (SELECT l_suppkey, l_orderkey,
                      CASE WHEN l_orderkey = min(l_orderkey) OVER (PARTITION BY l_suppkey)
                           THEN 'I' ELSE 'U' END AS op
               FROM lineitem)
    SELECT l_suppkey, op, count(*) AS "rows", CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM m GROUP BY 1, 2
    """,
)
def lines_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Few, frequent keys: the order stands in for the batch, and some keys go the broadcast way."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey")
    marked = classify(lines, ["l_suppkey"], batch="l_orderkey", hot_rows=600)
    return marked.groupBy("l_suppkey", "op").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("key_sum"))


@query(
    "lines_versions_sparse",
    """
    WITH v AS (
      SELECT CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_suppkey END AS key, l_orderkey * 1000000 AS batch, max(l_partkey) AS part
      FROM lineitem GROUP BY 1, 2),
    w AS (SELECT *, lead(batch) OVER (PARTITION BY key ORDER BY batch) AS valid_to FROM v)
    SELECT key, count(*) AS versions, CAST(sum(part) AS BIGINT) AS parts, count(valid_to) AS ended,
           CAST(sum(coalesce(valid_to, 0) // 1000000 * (batch // 1000000 % 7)) AS BIGINT) AS chained
    FROM w GROUP BY key
    """,
)
def lines_versions_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Batch numbers far apart, and one key with a third of all rows."""
    key = F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey").cast("long"))
    lines = table(spark, folder, "lineitem").select(key.alias("key"), (F.col("l_orderkey") * 1_000_000).alias("batch"), "l_partkey")
    found = versions(lines, ["key"], piece=100)
    step = F.call_function("div", F.col("batch"), F.lit(1_000_000)) % 7
    ended = F.call_function("div", F.coalesce("valid_to", F.lit(0).cast("long")), F.lit(1_000_000))
    return found.groupBy("key").agg(
        F.count(F.lit(1)).alias("versions"), F.sum("l_partkey").cast("long").alias("parts"), F.count("valid_to").alias("ended"),
        F.sum(ended * step).cast("long").alias("chained"),
    )


_TRANSACTIONS_SQL = f"""
    WITH {SLOTS_SQL}
    SELECT {_SHIFTED_KEY} AS o_orderkey, o_custkey, {_RAISED} AS o_totalprice, batch, op FROM placed
"""
_KEYED_VERSIONS_SQL = f"""
    SELECT *, batch AS valid_from, lead(batch) OVER (PARTITION BY o_orderkey ORDER BY batch) AS valid_to FROM ({_TRANSACTIONS_SQL})
"""
_STATES = {
    ObjectType.STANDARD: _ASSIGNED_SQL,
    ObjectType.STANDARD_WITH_EXTERNAL_ID: _UPSERT_SQL,
    ObjectType.STANDARD_BITEMPORAL: _VERSIONS_SQL,
    ObjectType.VERSIONED_BITEMPORAL: _VERSIONS_SQL,
    ObjectType.STANDARD_TRANSACTIONAL: _TRANSACTIONS_SQL,
    ObjectType.VERSIONED_TRANSACTIONAL: _KEYED_VERSIONS_SQL,
    ObjectType.COMPLETE_SNAPSHOT: _REPLACED_SQL,
    ObjectType.INCREMENTAL_SNAPSHOT: _MERGED_SQL,
}


def feed_on_disk(spark: SparkSession, folder: str, kind: ObjectType) -> tuple[FeedSpec, str, DataFrame]:
    """The feed of orders of a type, its CSV folders, and the feed as read from them."""
    options = {} if not kind.has_candidate_key else _BY_KEY
    spec, path = order_spec(spark, folder, kind, **options), scratch_path(spark, "feed")
    feed = order_feed(spark, folder, kind, **options)
    write_feed_csv(feed, path, spec, operations=True)
    return spec, path, read_feed_csv(spark, path, spec, feed.schema, operations=True)


def _register_state(kind: ObjectType, sql: str) -> None:
    @query(f"state_{kind.value}", sql)
    def state(spark: SparkSession, folder: str) -> DataFrame:
        """CSV batches applied in two jobs, of which the second is run twice; the state as readers see it."""
        spec, _, feed = feed_on_disk(spark, folder, kind)
        store = ObjectTable(scratch_path(spark, "states"), "demo", "sales", kind.value)
        for batches in (F.col("batch") < 3, F.lit(True), F.lit(True)):
            apply_feed(feed.filter(batches), store, spec, order=["o_orderkey"])
        return read_state(spark, store)


for _kind, _sql in _STATES.items():
    _register_state(_kind, _sql)


@query("state_from_stream", _UPSERT_SQL)
def state_from_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same batches applied by a stream, a few files at a time."""
    spec, path, feed = feed_on_disk(spark, folder, ObjectType.STANDARD_WITH_EXTERNAL_ID)
    store = ObjectTable(scratch_path(spark, "states"), "demo", "sales", "streamed")
    stream = follow_feed(spark, path, store, spec, feed.schema, scratch_path(spark, "stream"), operations=True, files_per_round=4)
    stream.awaitTermination()
    return read_state(spark, store)
