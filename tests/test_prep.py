from __future__ import annotations

from math import ceil

import pytest
from pyspark.sql import functions as F

from tablewright.operators.labels import decoded, distinct_labels, label_codes, label_list, with_codes
from tablewright.operators.measures import (
    accuracy,
    class_means,
    mean_absolute_error,
    observed_accuracy,
    split_shapes,
)
from tablewright.operators.missing import fill_means, fit_means
from tablewright.operators.splits import exact_split, keyed_split
from tests.conftest import plan, rows


def test_split_ignores_partitioning_and_keeps_copies_together(spark):
    df = spark.range(500).unionAll(spark.range(500))
    a, b = keyed_split(df, ["id"], 0.2, 42), keyed_split(df.repartition(5), ["id"], 0.2, 42)
    assert rows(a) == rows(b)
    assert a.distinct().count() == 500
    other = keyed_split(df, ["id"], 0.2, 43)
    assert rows(a) != rows(other)


@pytest.mark.parametrize("share", [0.2, 0.25, 0.5])
def test_split_share_is_close(spark, share):
    tests = keyed_split(spark.range(20_000), ["id"], share, 1).filter("split = 'test'").count()
    assert abs(tests / 20_000 - share) < 0.015


@pytest.mark.parametrize("n, share", [(1, 0.2), (7, 0.25), (10, 0.2), (1003, 0.2), (1000, 0.25)])
def test_exact_split_sizes(spark, n, share):
    split = exact_split(spark.range(n), ["id"], share, 42)
    assert split.filter("split = 'test'").count() == ceil(share * n)
    assert "Window" not in plan(split) and "Exchange" not in plan(split)


def test_exact_split_of_an_empty_frame(spark):
    assert exact_split(spark.range(0), ["id"], 0.2, 1).count() == 0


def test_exact_split_divides_rows_that_share_the_key_at_the_cut(spark, folder):
    spark.range(300).select((F.col("id") % 3).alias("k"), "id").repartition(4).write.parquet(folder + "/t")
    df = spark.read.parquet(folder + "/t")
    for share in (0.1, 0.2, 0.5, 0.9):
        split = exact_split(df, ["k"], share, 1)
        assert rows(split.groupBy("split").count()) == [("test", round(300 * share)), ("train", 300 - round(300 * share))]
        assert split.select("id").distinct().count() == 300
        mixed = split.groupBy("k").agg(F.count_distinct("split").alias("sides")).filter("sides > 1").count()
        assert mixed <= 1


def test_labels_are_coded_in_sorted_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "y string")
    codes = label_codes(df, "y")
    assert rows(codes) == [("a", 0), ("b", 1), ("c", 2)] and label_list(df, "y") == ["a", "b", "c"]
    assert rows(with_codes(df, "y", codes, "code")) == [("a", 0), ("a", 0), ("b", 1), ("c", 2), (None, None)]
    assert rows(with_codes(df, "y", codes.filter("code = 0"), "code"))[2] == ("b", None)
    assert rows(with_codes(df, "y", codes.limit(0), "code"))[0] == ("a", None)
    assert distinct_labels(df, "y").count() == 3


def test_number_labels_are_sorted_as_numbers(spark):
    df = spark.createDataFrame([(10,), (9,), (-1,), (9,)], "y int")
    assert label_list(df, "y") == ["-1", "9", "10"]
    assert rows(with_codes(df, "y", label_codes(df, "y"), "code")) == [(-1, 0), (10, 2), (9, 1), (9, 1)]


def test_classes_may_be_as_many_as_rows(spark):
    codes = label_codes(spark.range(20_000), "id")
    assert codes.count() == 20_000 and codes.filter("label <> code").count() == 0


def test_decoding_outside_the_range_gives_null(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,), (None,)], "c int")
    codes = spark.createDataFrame([("x", 0), ("y", 1)], "label string, code int")
    assert rows(decoded(df, "c", codes, "name")) == [(-1, None), (0, "x"), (1, "y"), (2, None), (None, None)]


def test_means_come_from_training_rows_only(spark):
    df = spark.createDataFrame(
        [("train", 1.0, None), ("train", 3.0, None), ("test", 100.0, 5.0), ("test", None, 6.0), ("train", float("nan"), None)],
        "split string, a double, void double",
    )
    means = fit_means(df, ["a", "void"], F.col("split") == "train")
    assert means == {"a": 2.0, "void": None}
    filled = fill_means(df, means)
    assert filled.columns == ["split", "a"]
    assert sorted(r.a for r in filled.collect()) == [1.0, 2.0, 2.0, 3.0, 100.0]


def test_integers_and_booleans_impute_too(spark):
    df = spark.createDataFrame([(1, None), (None, 4)], "a int, b long")
    means = fit_means(df, ["a", "b"])
    assert rows(fill_means(df, means)) == [(1.0, 4.0), (1.0, 4.0)]


def test_measures(spark):
    df = spark.createDataFrame(
        [("train", 1, 1), ("train", 2, 1), ("test", 0, 0), ("test", 3, 1), ("test", None, 1)], "split string, p int, y int"
    )
    assert rows(accuracy(df, "p", "y")) == [("all", 5, 0.4), ("test", 3, 1 / 3), ("train", 2, 0.5)]
    assert rows(mean_absolute_error(df, "p", "y")) == [("all", 4, 0.75), ("test", 2, 1.0), ("train", 2, 0.5)]
    assert rows(split_shapes(df)) == [("test", 3, 2), ("train", 2, 2)]
    assert df.count() == 5
    assert rows(class_means(df, ["split"], ["y"])) == [("test", 3, 0.6667), ("train", 2, 1.0)]


def test_observed_accuracy_is_the_accuracy(spark):
    df = spark.createDataFrame([("train", 1, 1), ("train", 2, 1), ("test", 0, 0), ("test", None, 1), ("test", 1, None)], "split string, p int, y int")
    watched, result = observed_accuracy(df, "p", "y", "split", ("train", "test", "none"))
    assert watched.count() == 5
    assert result() == {"train": (2, 0.5), "test": (2, 0.5), "none": (0, None), "all": (4, 0.5)}
    assert rows(accuracy(df.filter("y IS NOT NULL"), "p", "y")) == [("all", 4, 0.5), ("test", 2, 0.5), ("train", 2, 0.5)]
