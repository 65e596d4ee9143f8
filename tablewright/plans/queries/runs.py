"""Workload grids, run statistics and measured round trips."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.feeds import ObjectType
from tablewright.operators.filters import stacked
from tablewright.plans.queries.registry import query, table
from tablewright.plans.queries.storage import scratch_table
from tablewright.plans.roundtrip import geometric_series, run_volumes, shape_for_store, volume_grid
from tablewright.plans.workloads import volume_run
from tablewright.schemas import FACTS
from tablewright.session import scratch_path, written
from tablewright.sinks.stats import grouped_runs, long_form, read_stats, write_stats
from tablewright.sinks.text import write_csv
from tablewright.sources.facts import facts_for
from tablewright.sources.objects import read_object
from tablewright.sources.text import read_csv


def order_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Run statistics read off orders: twelve (freq, record_count) cells, prices as times."""
    key, cell = F.col("o_orderkey"), F.col("o_orderkey") % 12
    return table(spark, folder, "orders").select(
        F.concat(F.lit("r"), F.floor(F.floor(key / 12) / (cell % 3 + 1)).cast("string")).alias("run"),
        (cell % 3 + 1).cast("int").alias("freq"),
        (F.lit(10) * F.floor(cell / 3 + 1)).cast("long").alias("record_count"),
        (F.floor(key / 12) % (cell % 3 + 1)).cast("int").alias("iteration"),
        (F.floor("o_totalprice") + 0.5).alias("read_s"),
        F.floor(F.col("o_totalprice") / 2).cast("double").alias("write_s"),
    )


_STATS_SQL = """
    stats AS (
      SELECT concat('r', (o_orderkey // 12) // ((o_orderkey % 12) % 3 + 1)) AS run, CAST((o_orderkey % 12) % 3 + 1 AS INTEGER) AS freq,
             CAST(10 * ((o_orderkey % 12) // 3 + 1) AS BIGINT) AS record_count,
             CAST((o_orderkey // 12) % ((o_orderkey % 12) % 3 + 1) AS INTEGER) AS iteration, floor(o_totalprice) + 0.5 AS read_s,
             floor(o_totalprice / 2) AS write_s
      FROM orders)
"""


@query(
    "geometric_grid",
    """
    WITH m AS (SELECT CAST(ceil(log2(greatest(count(*), 10) / 10)) AS BIGINT) + 2 AS terms FROM orders),
         s AS (SELECT CAST(range AS INTEGER) AS term, CAST(10 * pow(2, range - 1) AS BIGINT) AS value
               FROM range(1, 64), m WHERE range <= terms)
    SELECT term, value, (SELECT count(*) FROM orders WHERE o_orderkey < value) AS available FROM s
    """,
)
def geometric_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Doubling record counts, and how many orders each of them would find."""
    orders = table(spark, folder, "orders")
    terms = math.ceil(math.log2(max(orders.count(), 10) / 10)) + 2
    grid = geometric_series(spark, 10, 2, terms)
    first_term = F.greatest(F.lit(1), F.ceil(F.log2((F.col("o_orderkey") + 1) / 10)) + 1).cast("int")
    reached = orders.groupBy(first_term.alias("from_term")).agg(F.count(F.lit(1)).alias("n"))
    within = reached.withColumn("term", F.explode(F.sequence("from_term", F.greatest(F.col("from_term"), F.lit(terms)))))
    available = within.filter(F.col("term") <= terms).groupBy("term").agg(F.sum("n").alias("available"))
    return grid.join(available, "term", "left").withColumn("available", F.coalesce("available", F.lit(0)))


@query(
    "stats_grouped",
    f"""
    WITH {_STATS_SQL}
    SELECT run, freq, record_count, count(*) AS "runs",
           string_agg(concat(iteration, '/', CAST(write_s AS BIGINT)), ',' ORDER BY iteration) AS listed
    FROM stats GROUP BY run, freq, record_count
    """,
)
def stats_grouped(spark: SparkSession, folder: str) -> DataFrame:
    grouped = grouped_runs(order_stats(spark, folder))
    shown = F.transform(
        "runs",
        lambda r: F.concat(r["iteration"].cast("string"), F.lit("/"), r["write_s"].cast("long").cast("string")),
    )
    return grouped.select(
        "run", "freq", "record_count", F.size("runs").cast("long").alias("runs"), F.array_join(shown, ",").alias("listed")
    )


@query(
    "stats_long",
    f"""
    WITH {_STATS_SQL}
    SELECT format('({{}}, {{}})', freq, record_count) AS combination, 'Read' AS type, read_s AS time FROM stats
    UNION ALL SELECT format('({{}}, {{}})', freq, record_count), 'Write', write_s FROM stats
    """,
)
def stats_long(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(order_stats(spark, folder))


@query(
    "stats_json",
    f"WITH {_STATS_SQL} SELECT run, freq, record_count, iteration, read_s, write_s FROM stats",
)
def stats_json(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stats")
    write_stats(order_stats(spark, folder), path)
    return read_stats(spark, path)


@query(
    "roundtrip_stats",
    """
    WITH n AS (SELECT count(*) AS n FROM orders)
    SELECT 1 AS freq, n // 2 AS record_count, 0 AS iteration, TRUE AS "read", TRUE AS written, 1 AS runs FROM n
    UNION ALL SELECT 2, n, 0, TRUE, TRUE, 1 FROM n UNION ALL SELECT 2, n, 1, TRUE, TRUE, 1 FROM n
    """,
)
def roundtrip_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Timed write and read of half and of all orders, the latter twice: one run, and every time measured."""
    orders = table(spark, folder, "orders")
    shaped = shape_for_store(orders, ["O_ORDERKEY", "o_custkey", "o_totalprice", "o_orderstatus"])
    n = orders.count()
    stats = run_volumes(shaped, scratch_table(spark, "volume"), [(1, n // 2, 0), (2, n, 0), (2, n, 1)])
    runs = stats.select("run").distinct().count()
    return stats.select("freq", "record_count", "iteration", (F.col("read_s") > 0).alias("read"), (F.col("write_s") > 0).alias("written"), F.lit(runs).alias("runs"))


@query(
    "roundtrip_complete",
    """
    SELECT 1 AS freq, count(*) // 2 AS record_count, 0 AS iteration, TRUE AS timed FROM orders
    UNION ALL SELECT 1, count(*), 0, TRUE FROM orders
    """,
)
def roundtrip_complete(spark: SparkSession, folder: str) -> DataFrame:
    """The same runs without their times: every cell wrote, read back and matched."""
    orders = table(spark, folder, "orders")
    n = orders.count()
    stats = run_volumes(orders, scratch_table(spark, "volume"), [(1, n // 2, 0), (1, n, 0)])
    done = (F.col("read_s") > 0) & (F.col("write_s") > 0)
    return stats.select("freq", "record_count", "iteration", done.alias("timed"))


_LEADS = {
    kind: f"sales_{'external_' if kind.has_external_id else ''}id,is_deleted,PRODUCT_ID"
    if kind is ObjectType.STANDARD or kind.has_external_id else "is_deleted,PRODUCT_ID,channel_id"
    for kind in ObjectType
}


@query(
    "volume_run_by_type",
    f"""
    WITH n AS (SELECT count(*) AS n FROM orders)
    SELECT kind, freq, record_count, iteration, stored
    FROM n, (VALUES {', '.join(f"('{kind.value}', '{lead}')" for kind, lead in _LEADS.items())}) AS k (kind, lead),
         LATERAL (SELECT 1 AS freq, n // 4 AS record_count, 0 AS iteration
                  UNION ALL SELECT 1, n, 0) AS c,
         LATERAL (SELECT concat(lead, ',', n // 4 + n) AS stored) AS s
    """,
)
def volume_run_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Facts for all orders go to CSV, which is parsed once; per object type they are shaped, appended and read back."""
    path = scratch_path(spark, "facts")
    orders = table(spark, folder, "orders")
    write_csv(facts_for(orders, "o_orderkey", seed=5), path)
    facts = written(read_csv(spark, path, FACTS), "parsed-facts")
    n, sides = orders.count(), []
    for kind in ObjectType:
        store = scratch_table(spark, "sales")
        stats = volume_run(spark, facts, store, kind, [(1, n // 4, 0), (1, n, 0)])
        held = read_object(spark, store)
        lead = ",".join([*held.columns[:3], str(held.count())])
        sides.append(stats.select(F.lit(kind.value).alias("kind"), "freq", "record_count", "iteration", F.lit(lead).alias("stored")))
    return stacked(sides)


@query(
    "volume_grid_runs",
    """
    WITH q AS (SELECT count(*) // 2 AS q FROM orders)
    SELECT freq, record_count, iteration, 9 * q AS stored, TRUE AS timed
    FROM q, (VALUES (1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 1, 1), (2, 2, 0), (2, 2, 1)) AS c (freq, times, iteration),
         LATERAL (SELECT times * q AS record_count) AS r
    """,
)
def volume_grid_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The grid of doubled volumes and frequencies, from CSV facts for half of and all orders."""
    path = scratch_path(spark, "facts")
    orders = table(spark, folder, "orders")
    write_csv(facts_for(orders, "o_orderkey", seed=5), path)
    store = scratch_table(spark, "sales")
    grid = volume_grid(spark, orders.count() // 2, 2, 2)
    stats = volume_run(spark, path, store, ObjectType.STANDARD_TRANSACTIONAL, grid, schema=FACTS)
    timed = (F.col("read_s") > 0) & (F.col("write_s") > 0)
    return stats.select("freq", "record_count", "iteration", F.lit(read_object(spark, store).count()).cast("long").alias("stored"), timed.alias("timed"))
