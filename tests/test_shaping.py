from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.operators.filters import index_between, labelled, pool_head, stacked
from tablewright.operators.shaping import (
    blanked,
    incremented,
    lower_names,
    numeric_columns,
    only_numeric,
    renamed,
    reorder,
    with_first,
    with_null_id,
    with_row_key,
    with_surrogate_id,
    without,
)
from tests.conftest import rows


def test_lower_then_select_carries_the_requested_case(spark):
    df = lower_names(spark.createDataFrame([(1, 2)], "Product_Id int, NRX int"))
    assert df.columns == ["product_id", "nrx"]
    assert reorder(df, ["nrx", "PRODUCT_ID"]).columns == ["nrx", "PRODUCT_ID"]


def test_names_that_collide_are_refused(spark):
    with pytest.raises(ValueError, match="differ only in case"):
        lower_names(spark.range(1).toDF("a").withColumn("b", F.lit(1)).toDF("a", "A"))


def test_odd_names_survive(spark):
    df = spark.createDataFrame([(1, 2)], ["1stFlrSF", "a.b"])
    assert reorder(df, ["a.b", "1stFlrSF"]).first() == (2, 1)
    assert only_numeric(df).columns == ["1stFlrSF", "a.b"]
    assert with_first(df, "x", F.lit(0)).columns == ["x", "1stFlrSF", "a.b"]


def test_ids_come_first(spark):
    df = spark.range(100).repartition(3)
    ids = with_surrogate_id(df, "row_id")
    assert ids.columns == ["row_id", "id"] and ids.select("row_id").distinct().count() == 100
    assert ids.schema["row_id"].dataType.simpleString() == "bigint"
    empty = with_null_id(df, "product")
    assert empty.columns[0] == "product_id" and empty.filter("product_id IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        with_surrogate_id(df, "")


def test_row_key_does_not_depend_on_partitioning(spark):
    df = spark.range(50)
    assert rows(with_row_key(df, "k", ["id"])) == rows(with_row_key(df.repartition(7), "k", ["id"]))


def test_numeric_columns_keep_booleans(spark):
    df = spark.createDataFrame([(1, 2.0, True, "x")], "i int, d double, b boolean, s string")
    assert numeric_columns(df) == ["i", "d", "b"]
    assert only_numeric(df, drop=["d"]).columns == ["i", "b"]


def test_column_edits(spark):
    df = spark.createDataFrame([(1, "x")], "k int, s string")
    assert incremented(df, ["k"]).first() == (2, "x")
    assert blanked(df, ["s"]).first() == (1, "")
    assert renamed(df, {"s": "t"}).columns == ["k", "t"]
    assert without(df, ["s", "absent"]).columns == ["k"]
    with pytest.raises(ValueError):
        renamed(df, {"absent": "t"})


def test_filters_and_unions(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 6.0)], "i int, y double")
    assert rows(labelled(df, "y")) == [(2, 5.0), (3, 6.0)]
    assert rows(index_between(df, "i", 2, 3).select("i")) == [(2,), (3,)]
    assert index_between(df, "i", 3, 2).count() == 0
    assert rows(pool_head(df, "i", 2).select("i")) == [(1,), (2,)]
    swapped = df.select("y", "i")
    assert rows(stacked([df, swapped]).select("i")) == [(1,), (1,), (2,), (2,), (3,), (3,)]
    assert stacked([df, df.drop("y")]).filter("y IS NULL").count() == 4
    with pytest.raises(ValueError):
        stacked([])
