"""Preparing rows for a model: labels, gaps, splits, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.filters import labelled
from tablewright.operators.labels import decoded, distinct_labels, label_codes, with_codes
from tablewright.operators.measures import accuracy, class_means, mean_absolute_error, split_shapes
from tablewright.operators.missing import fill_means, fit_means
from tablewright.operators.shaping import features_to_double, lower_names, reorder
from tablewright.operators.splits import exact_split, keyed_split
from tablewright.plans.queries.registry import query, table

LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# 16^8 * 0.2 and 16^8 * 0.25 in hex, the bounds of a 20 % and a 25 % share.
_LINE_SPLIT = """CASE WHEN substr(md5(concat(l_orderkey, ':', l_linenumber, ':', '42')), 1, 8) < '33333333'
                  THEN 'test' ELSE 'train' END"""
_LINE_SPLIT_25 = """CASE WHEN substr(md5(concat(l_orderkey, ':', l_linenumber, ':', '7')), 1, 8) < '40000000'
                  THEN 'test' ELSE 'train' END"""


@query(
    "prepared_training_set",
    f"""
    WITH p AS (
      SELECT {_LINE_SPLIT} AS split, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax,
             CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label_code
      FROM lineitem)
    SELECT split, l_returnflag, label_code, count(*) AS "rows", round(avg(l_quantity), 4) AS avg_l_quantity,
           round(avg(l_extendedprice), 4) AS avg_l_extendedprice, round(avg(l_discount), 4) AS avg_l_discount,
           round(avg(l_tax), 4) AS avg_l_tax
    FROM p GROUP BY split, l_returnflag, label_code
    """,
)
def prepared_training_set(spark: SparkSession, folder: str) -> DataFrame:
    """Shape, cast, code the label, split; rows and feature means per split and class."""
    lines = lower_names(table(spark, folder, "lineitem"))
    kept = reorder(lines, [*LINE_KEYS, *LINE_FEATURES, "l_returnflag"])
    coded = with_codes(kept, "l_returnflag", label_codes(kept, "l_returnflag"), "label_code")
    split = keyed_split(features_to_double(coded, LINE_FEATURES), LINE_KEYS, 0.2, 42)
    return class_means(split, ["split", "l_returnflag", "label_code"], LINE_FEATURES)


def _gappy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items whose zero discounts count as missing (the tables themselves hold no NULL)."""
    lines = table(spark, folder, "lineitem")
    return lines.withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))


@query(
    "drop_unlabelled",
    """
    SELECT l_linestatus, count(*) AS "rows", round(avg(l_discount), 4) AS avg_l_discount
    FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL GROUP BY l_linestatus
    """,
)
def drop_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return class_means(labelled(_gappy_lines(spark, folder), "l_discount"), ["l_linestatus"], ["l_discount"])


@query(
    "mean_impute_train_fit",
    f"""
    WITH s AS (SELECT {_LINE_SPLIT_25} AS split, nullif(l_discount, 0) AS d, l_quantity AS q FROM lineitem),
         m AS (SELECT avg(d) FILTER (WHERE split = 'train') AS md FROM s)
    SELECT split, count(*) AS "rows", count(d) AS known, round(avg(coalesce(d, md)), 6) AS avg_discount,
           round(max(md), 6) AS fitted, round(avg(q), 4) AS avg_quantity
    FROM s, m GROUP BY split
    """,
)
def mean_impute_train_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyed_split(_gappy_lines(spark, folder), LINE_KEYS, 0.25, 7).select(
        "split", "l_discount", "l_quantity", F.col("l_discount").alias("raw"), F.lit(None).cast("double").alias("void")
    )
    means = fit_means(rows, ["l_discount", "l_quantity", "void"], F.col("split") == "train")
    filled = fill_means(rows, means)
    return filled.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("raw").alias("known"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.round(F.lit(means["l_discount"]), 6).alias("fitted"),
        F.round(F.avg("l_quantity"), 4).alias("avg_quantity"),
    )


@query(
    "label_codes",
    """
    SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code,
           c_mktsegment AS decoded
    FROM customer
    """,
)
def segment_codes(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    codes = label_codes(customers, "c_mktsegment")
    return decoded(with_codes(customers, "c_mktsegment", codes, "code"), "code", codes, "decoded")


@query(
    "label_codes_of_names",
    """
    SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code, c_name AS decoded FROM customer
    """,
)
def name_codes(spark: SparkSession, folder: str) -> DataFrame:
    """A class for every customer: the number of classes grows with the table."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    codes = label_codes(customers, "c_name")
    return decoded(with_codes(customers, "c_name", codes, "code"), "code", codes, "decoded").drop("c_name")


@query("distinct_labels", "SELECT DISTINCT c_mktsegment FROM customer")
def distinct_segments(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_labels(table(spark, folder, "customer"), "c_mktsegment")


@query(
    "split_membership",
    """
    SELECT o_orderkey, CASE WHEN substr(md5(concat(o_orderkey, ':', '42')), 1, 8) < '33333333'
                            THEN 'test' ELSE 'train' END AS split
    FROM orders
    """,
)
def split_membership(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_split(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 42)


@query(
    "split_quarter",
    """
    SELECT CASE WHEN substr(md5(concat(o_orderkey, ':', '3')), 1, 8) < '40000000' THEN 'test' ELSE 'train' END
             AS split,
           count(*) AS "rows", CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM orders GROUP BY 1
    """,
)
def split_quarter(spark: SparkSession, folder: str) -> DataFrame:
    split = keyed_split(table(spark, folder, "orders"), ["o_orderkey"], 0.25, 3)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "split_sizes_exact",
    """
    WITH h AS (SELECT o_orderkey,
                      row_number() OVER (ORDER BY substr(md5(concat(o_orderkey, ':', '42')), 1, 15)) AS place,
                      count(*) OVER () AS n
               FROM orders)
    SELECT o_orderkey, CASE WHEN place <= (n + 4) // 5 THEN 'test' ELSE 'train' END AS split FROM h
    """,
)
def split_sizes_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_split(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 42)


@query(
    "split_shapes",
    f"""
    SELECT {_LINE_SPLIT} AS split, count(*) AS "rows", 4 AS columns FROM lineitem GROUP BY 1
    """,
)
def line_split_shapes(spark: SparkSession, folder: str) -> DataFrame:
    split = keyed_split(table(spark, folder, "lineitem"), LINE_KEYS, 0.2, 42)
    return split_shapes(split, "split", LINE_FEATURES)


@query(
    "mae_mean_baseline",
    f"""
    WITH s AS (SELECT {_LINE_SPLIT_25} AS split, l_extendedprice AS y FROM lineitem),
         m AS (SELECT avg(y) FILTER (WHERE split = 'train') AS mean FROM s),
         e AS (SELECT split, abs(y - mean) AS gap FROM s, m)
    SELECT split, count(*) AS "rows", round(avg(gap), 4) AS mae FROM e GROUP BY split
    UNION ALL SELECT 'all', count(*), round(avg(gap), 4) FROM e
    """,
)
def mae_mean_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Error of always predicting the training mean."""
    split = keyed_split(table(spark, folder, "lineitem"), LINE_KEYS, 0.25, 7)
    mean = fit_means(split, ["l_extendedprice"], F.col("split") == "train")["l_extendedprice"]
    errors = mean_absolute_error(split.withColumn("guess", F.lit(mean)), "guess", "l_extendedprice")
    return errors.withColumn("mae", F.round("mae", 4))


@query(
    "accuracy_majority_baseline",
    f"""
    WITH s AS (SELECT {_LINE_SPLIT} AS split, l_returnflag AS y FROM lineitem),
         g AS (SELECT y AS guess FROM s WHERE split = 'train' GROUP BY y ORDER BY count(*) DESC, y LIMIT 1),
         h AS (SELECT split, CASE WHEN y = guess THEN 1.0 ELSE 0.0 END AS hit FROM s, g)
    SELECT split, count(*) AS "rows", round(avg(hit), 6) AS accuracy FROM h GROUP BY split
    UNION ALL SELECT 'all', count(*), round(avg(hit), 6) FROM h
    """,
)
def accuracy_majority_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Share of hits when always predicting the most frequent training class."""
    split = keyed_split(table(spark, folder, "lineitem"), LINE_KEYS, 0.2, 42)
    counts = split.filter(F.col("split") == "train").groupBy("l_returnflag").count()
    guess = counts.orderBy(F.desc("count"), "l_returnflag").first()[0]
    shares = accuracy(split.withColumn("guess", F.lit(guess)), "guess", "l_returnflag")
    return shares.withColumn("accuracy", F.round("accuracy", 6))
