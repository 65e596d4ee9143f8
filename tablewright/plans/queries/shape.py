"""Column shaping, casts, identifiers, exact row limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.scalars import batch_suffix, external_id, id_number, nearest_code, truncated
from tablewright.operators.measures import class_means
from tablewright.operators.ranking import first_by_key, first_rows, preview
from tablewright.operators.shaping import (
    blanked,
    features_to_double,
    incremented,
    lower_names,
    only_numeric,
    renamed,
    reorder,
    with_null_id,
    with_row_key,
    with_surrogate_id,
    without,
)
from tablewright.plans.queries.registry import query, table


@query(
    "lowercase_reorder",
    """
    SELECT o_custkey, o_orderkey AS "O_ORDERKEY", o_totalprice, o_orderstatus FROM orders
    """,
)
def lowercase_reorder(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    shouted = orders.toDF(*[name.upper() for name in orders.columns])
    return reorder(lower_names(shouted), ["o_custkey", "O_ORDERKEY", "o_totalprice", "o_orderstatus"])


@query("typed_null_id", "SELECT CAST(NULL AS DOUBLE) AS order_id, o_orderkey, o_custkey FROM orders")
def typed_null_id(spark: SparkSession, folder: str) -> DataFrame:
    return with_null_id(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "order")


@query(
    "surrogate_id_stats",
    """
    SELECT count(*) AS "rows", count(DISTINCT o_orderkey) AS distinct_ids, 'order_external_id' AS first_column
    FROM orders
    """,
)
def surrogate_id_stats(spark: SparkSession, folder: str) -> DataFrame:
    ids = with_surrogate_id(table(spark, folder, "orders"), "order_external_id")
    per_id = ids.groupBy("order_external_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_ids")).withColumn(
        "first_column", F.lit(ids.columns[0])
    )


@query(
    "row_key",
    """
    SELECT md5(concat(coalesce(CAST(o_orderkey AS VARCHAR), ''), ':', coalesce(o_orderstatus, ''), ':', '7'))
             AS order_key,
           o_orderkey, o_orderstatus
    FROM orders
    """,
)
def row_key(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return with_row_key(orders, "order_key", ["o_orderkey", "o_orderstatus"], seed=7)


@query("numeric_columns_only", "SELECT p_partkey, p_size FROM part")
def numeric_columns_only(spark: SparkSession, folder: str) -> DataFrame:
    return only_numeric(table(spark, folder, "part"), drop=["p_retailprice"])


@query(
    "cast_features",
    """
    WITH text AS (
      SELECT l_returnflag, CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS big_discount,
             CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS line,
             CASE WHEN l_tax > 0.02 THEN 1.0 ELSE 0.0 END AS taxed
      FROM lineitem)
    SELECT l_returnflag, count(*) AS "rows", CAST(sum(big_discount) AS DOUBLE) AS big_discounts,
           count(line) AS lines, CAST(sum(line) AS DOUBLE) AS line_sum, CAST(sum(taxed) AS DOUBLE) AS taxed
    FROM text GROUP BY l_returnflag
    """,
)
def cast_features(spark: SparkSession, folder: str) -> DataFrame:
    """Text that spells booleans or numbers, a real boolean, and text that is neither (NULL)."""
    text = table(spark, folder, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_discount") > 0.05, F.lit("TRUE")).otherwise(F.lit("False")).alias("big_discount"),
        F.when(F.col("l_linenumber") == 7, F.lit("unknown"))
        .otherwise(F.col("l_linenumber").cast("string"))
        .alias("line"),
        (F.col("l_tax") > 0.02).alias("taxed"),
    )
    cast = features_to_double(text, ["big_discount", "line", "taxed"], strict=False)
    return cast.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("big_discount").alias("big_discounts"),
        F.count("line").alias("lines"),
        F.sum("line").alias("line_sum"),
        F.sum("taxed").alias("taxed"),
    )


@query(
    "feature_label_projection",
    """
    SELECT l_returnflag, count(*) AS "rows", round(avg(l_quantity), 4) AS avg_l_quantity,
           round(avg(l_tax), 4) AS avg_l_tax
    FROM lineitem GROUP BY l_returnflag
    """,
)
def feature_label_projection(spark: SparkSession, folder: str) -> DataFrame:
    kept = reorder(table(spark, folder, "lineitem"), ["l_orderkey", "l_quantity", "l_tax", "l_returnflag"])
    return class_means(kept, ["l_returnflag"], ["l_quantity", "l_tax"])


@query(
    "truncate_prediction",
    """
    SELECT CAST(trunc(l_extendedprice / 1000 - 50) AS INTEGER) AS predicted, count(*) AS "rows"
    FROM lineitem GROUP BY 1
    """,
)
def truncate_prediction(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.col("l_extendedprice") / 1000 - 50
    cut = table(spark, folder, "lineitem").select(truncated(raw).alias("predicted"))
    return cut.groupBy("predicted").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "nearest_prediction",
    """
    SELECT CAST(greatest(0, least(4, floor(l_extendedprice / 10000 - 2 + 0.5))) AS INTEGER) AS predicted,
           count(*) AS "rows"
    FROM lineitem GROUP BY 1
    """,
)
def nearest_prediction(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.col("l_extendedprice") / 10000 - 2
    rounded = table(spark, folder, "lineitem").select(nearest_code(raw, 5).alias("predicted"))
    return rounded.groupBy("predicted").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "external_id_format",
    """
    SELECT concat('ext_', o_orderkey + 1) AS external_id,
           split_part(concat('ext_', o_orderkey + 1), '_', 2) AS number_text,
           nullif(split_part(o_orderpriority, '_', 2), '') AS no_number,
           format('{:03d}', o_orderkey) AS suffix, '' AS status
    FROM orders
    """,
)
def external_id_format(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("ext", external_id(F.col("o_orderkey") + 1))
    shaped = orders.withColumns(
        {
            "number_text": id_number(F.col("ext")),
            "no_number": id_number(F.col("o_orderpriority")),
            "suffix": batch_suffix(F.col("o_orderkey")),
        }
    )
    named = renamed(blanked(shaped, ["o_orderstatus"]), {"ext": "external_id", "o_orderstatus": "status"})
    return without(named, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query("increment_columns", "SELECT o_orderkey + 1 AS o_orderkey, o_custkey + 1 AS o_custkey FROM orders")
def increment_columns(spark: SparkSession, folder: str) -> DataFrame:
    return incremented(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])


@query("first_rows_count", 'SELECT count(*) // 3 AS "rows", count(*) // 3 AS distinct_keys FROM orders')
def first_rows_count(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the table, whichever rows come first: their number is what is promised."""
    orders = table(spark, folder, "orders")
    taken = first_rows(orders, orders.count() // 3)
    per_key = taken.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"))


@query(
    "first_by_key",
    """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) // 3 FROM orders)
    """,
)
def first_orders_by_key(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return first_by_key(orders, "o_orderkey", orders.count() // 3)


@query("preview_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    return preview(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])
