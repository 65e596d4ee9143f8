"""Boosted trees on line items. Fitted numbers are not comparable across engines, so the
oracles check what must hold: sizes, and that the fit beats its baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.measures import mean_absolute_error
from tablewright.operators.missing import fit_means
from tablewright.plans.queries.prep import LINE_FEATURES, LINE_KEYS
from tablewright.plans.queries.registry import query, table
from tablewright.plans.queries.storage import scratch_table
from tablewright.plans.training import (
    CODE,
    PREDICTED,
    RAW,
    ClassTask,
    NumberTask,
    TreeSettings,
    load_model,
    number_errors,
    save_model,
    save_predictions,
    score,
    score_accuracy,
    score_numbers,
    train,
    train_numbers,
)
from tablewright.plans.workloads import regression_job, score_job, train_job
from tablewright.session import scratch_path
from tablewright.sinks.text import write_csv
from tablewright.sources.objects import read_object
from tablewright.sources.text import read_csv

TREES = TreeSettings(rounds=5, depth=4, least_partitions=8)

_BAND_SQL = """CASE WHEN l_extendedprice < 35000 THEN 'high discount' WHEN l_extendedprice < 70000 THEN 'middle'
               ELSE 'premium' END"""
_SPLIT_SQL = """CASE WHEN substr(md5(concat(l_orderkey, ':', l_linenumber, ':', '42')), 1, 8) < '33333333'
                 THEN 'test' ELSE 'train' END"""
_SPLIT_25_SQL = """CASE WHEN substr(md5(concat(l_orderkey, ':', l_linenumber, ':', '7')), 1, 8) < '40000000'
                 THEN 'test' ELSE 'train' END"""


def banded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a three-class label that their features determine."""
    price = F.col("l_extendedprice")
    band = F.when(price < 35000, F.lit("high discount")).when(price < 70000, F.lit("middle")).otherwise(F.lit("premium"))
    lines = table(spark, folder, "lineitem").withColumn("band", band)
    return lines.withColumn("is_taxed", F.col("l_tax") > 0)


def gappy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with gaps in features and target, a column without any value and one of text."""
    discount, price = F.col("l_discount"), F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        *LINE_KEYS,
        "l_quantity",
        "l_extendedprice",
        F.nullif(discount, F.lit(0.0)).alias("l_discount"),
        F.lit(None).cast("double").alias("never_known"),
        (F.col("l_tax") > 0).alias("is_taxed"),
        "l_linestatus",
        F.when(F.col("l_linenumber") < 7, price * (1 - discount)).alias("net"),
    )


BAND_TASK = ClassTask(LINE_KEYS, ["is_taxed", *LINE_FEATURES], "band", seed=42, test_share=0.2, trees=TREES)
NET_TASK = NumberTask(LINE_KEYS, "net", seed=7, test_share=0.25, trees=TREES)


@query(
    "gbt_label_scores",
    f"""
    WITH s AS (SELECT {_SPLIT_SQL} AS split FROM lineitem)
    SELECT split, count(*) AS "rows", TRUE AS good FROM s GROUP BY split
    UNION ALL SELECT 'all', count(*), TRUE FROM s
    """,
)
def gbt_label_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Encode, split, fit, score every row; rounded codes hit far more often than one class in three."""
    lines = banded_lines(spark, folder)
    shares = score_accuracy(score(train(lines, BAND_TASK), lines, BAND_TASK, nearest=True))
    return shares.select("split", "rows", (F.col("accuracy") > 0.9).alias("good"))


@query(
    "gbt_model_reload",
    f"""
    SELECT {_BAND_SQL} AS band, {_SPLIT_SQL} AS split, count(*) AS "rows",
           CAST(count(*) AS BIGINT) AS stored, TRUE AS same
    FROM lineitem GROUP BY 1, 2
    """,
)
def gbt_model_reload(spark: SparkSession, folder: str) -> DataFrame:
    """Save, load, score with both, append the predictions to a table of their own."""
    lines, path = banded_lines(spark, folder), scratch_path(spark, "model")
    model = train(lines, BAND_TASK)
    save_model(model, path)
    again = score(load_model(path), lines, BAND_TASK)
    store = scratch_table(spark, "predictions")
    save_predictions(again, BAND_TASK, store)
    stored = read_object(spark, store)
    columns_kept = stored.columns == [*BAND_TASK.keys, *BAND_TASK.features, BAND_TASK.label]
    sides = [("a", score(model, lines, BAND_TASK)), ("b", again)]
    sums = []
    for side, scored in sides:
        sums.append(
            scored.groupBy("band", "split")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(PREDICTED).alias("codes"), F.round(F.sum(RAW), 3).alias("raw"))
            .withColumn("side", F.lit(side))
        )
    both = sums[0].unionByName(sums[1]).groupBy("band", "split").agg(
        F.max("rows").alias("rows"),
        ((F.min("codes") == F.max("codes")) & (F.min("raw") == F.max("raw"))).alias("same"),
    )
    counts = again.groupBy("band", "split").agg(F.count(CODE).alias("stored"))
    checked = both.join(counts, ["band", "split"])
    intact = F.lit(columns_kept and stored.count() == lines.count())
    return checked.select("band", "split", "rows", "stored", (F.col("same") & intact).alias("same"))


@query(
    "gbt_gap_regression",
    f"""
    WITH s AS (SELECT {_SPLIT_25_SQL} AS split FROM lineitem WHERE l_linenumber < 7)
    SELECT split, count(*) AS "rows", TRUE AS good FROM s GROUP BY split
    UNION ALL SELECT 'all', count(*), TRUE FROM s
    """,
)
def gbt_gap_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Drop rows without target, impute from training rows, fit; the error is under half the mean's error."""
    lines = gappy_lines(spark, folder)
    model, prepared = train_numbers(lines, NET_TASK)
    errors = number_errors(score_numbers(model, prepared), NET_TASK)
    mean = fit_means(prepared, ["net"], F.col("split") == "train")["net"]
    naive = mean_absolute_error(prepared.withColumn("guess", F.lit(mean)), "guess", "net")
    both = errors.join(naive.select("split", F.col("mae").alias("naive")), "split")
    return both.select("split", "rows", (F.col("mae") < F.col("naive") / 2).alias("good"))


@query(
    "gbt_regression_metrics",
    f"""
    WITH s AS (SELECT {_SPLIT_SQL} AS split FROM lineitem)
    SELECT split, count(*) AS "rows", TRUE AS rounding_is_no_worse FROM s GROUP BY split
    UNION ALL SELECT 'all', count(*), TRUE FROM s
    """,
)
def gbt_regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Rounded codes hit at least as often as codes cut toward zero."""
    lines = banded_lines(spark, folder)
    model = train(lines, BAND_TASK)
    cut = score_accuracy(score(model, lines, BAND_TASK)).withColumnRenamed("accuracy", "accuracy_cut")
    near = score_accuracy(score(model, lines, BAND_TASK, nearest=True)).select("split", "accuracy")
    both = cut.join(near.withColumnRenamed("accuracy", "accuracy_nearest"), "split")
    return both.select("split", "rows", (F.col("accuracy_nearest") >= F.col("accuracy_cut")).alias("rounding_is_no_worse"))


@query(
    "gbt_jobs_from_csv",
    f"""
    WITH s AS (SELECT {_SPLIT_SQL} AS split FROM lineitem), n AS (SELECT count(*) AS stored FROM lineitem),
         r AS (SELECT split, count(*) AS "rows" FROM s GROUP BY split UNION ALL SELECT 'all', count(*) FROM s)
    SELECT split, "rows", TRUE AS good, stored FROM r, n
    """,
)
def gbt_jobs_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The training and the scoring job over a CSV source: model saved, loaded, predictions stored."""
    source, model = scratch_path(spark, "lines"), scratch_path(spark, "model")
    lines = banded_lines(spark, folder).select(*LINE_KEYS, *BAND_TASK.features, "band")
    write_csv(lines, source)
    train_job(read_csv(spark, source, lines.schema), BAND_TASK, model)
    store = scratch_table(spark, "predictions")
    done = score_job(read_csv(spark, source, lines.schema), BAND_TASK, model, store, nearest=True)
    shares = spark.createDataFrame([(split, n, hit) for split, (n, hit) in done.accuracy.items()], "split string, rows long, accuracy double")
    stored = read_object(spark, store, load=done.predictions.load).count()
    return shares.select("split", "rows", (F.col("accuracy") > 0.9).alias("good"), F.lit(stored).cast("long").alias("stored"))


@query(
    "gbt_regression_from_csv",
    f"""
    WITH s AS (SELECT {_SPLIT_25_SQL} AS split FROM lineitem WHERE l_linenumber < 7)
    SELECT split, count(*) AS "rows", TRUE AS good FROM s GROUP BY split
    UNION ALL SELECT 'all', count(*), TRUE FROM s
    """,
)
def gbt_regression_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The regression job over a CSV source with marked gaps; the error is under half the target's deviation."""
    path, lines = scratch_path(spark, "lines"), gappy_lines(spark, folder)
    write_csv(lines, path, missing="NA")
    errors = regression_job(spark, path, NET_TASK, schema=lines.schema)
    spread = lines.agg(F.stddev_pop("net")).first()[0]
    return errors.select("split", "rows", (F.col("mae") < F.lit(spread) / 2).alias("good"))
