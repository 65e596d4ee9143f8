from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators.ranking import first_by_key, first_rows, nth_smallest, preview

MIN, MAX = -(1 << 63), (1 << 63) - 1


@pytest.mark.parametrize("n", [0, 1, 7, 250, 999, 1000, 5000])
def test_first_rows_is_exact_over_many_partitions(spark, folder, n):
    spark.range(1000).repartition(7).write.parquet(folder + "/t")
    taken = first_rows(spark.read.parquet(folder + "/t"), n)
    assert taken.columns == ["id"]
    ids = [r.id for r in taken.collect()]
    assert len(ids) == len(set(ids)) == min(n, 1000)


def test_first_rows_does_not_gather_rows(spark, folder):
    spark.range(1000).repartition(7).write.parquet(folder + "/t")
    df = spark.read.parquet(folder + "/t")
    kept = first_rows(df, 900)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        first_rows(df, -1)


def test_first_rows_of_a_shuffled_frame_are_written_first(spark):
    df = spark.range(1000).repartition(7, "id").groupBy("id").count()
    assert {r.id for r in first_rows(df, 10).collect()} <= set(range(1000)) and first_rows(df, 400).count() == 400


def test_first_rows_of_nothing(spark):
    assert first_rows(spark.range(0), 5).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(MIN, MAX) | st.integers(-5, 5), min_size=1, max_size=40), st.data())
def test_nth_smallest_matches_sorting(spark, values, data):
    n = data.draw(st.integers(1, len(values)))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    value, below, at = nth_smallest(df, "v", n, buckets=16, few=2, scanned=data.draw(st.booleans()))
    ordered = sorted(values)
    assert value == ordered[n - 1]
    assert (below, at) == (sum(v < value for v in values), values.count(value))


def test_nth_smallest_refuses_what_is_not_there(spark):
    df = spark.createDataFrame([(1,), (None,)], "v long")
    assert nth_smallest(df, "v", 1) == (1, 0, 1)
    with pytest.raises(ValueError):
        nth_smallest(df, "v", 2)
    with pytest.raises(ValueError):
        nth_smallest(df, "v", 0)


def test_first_by_key_with_a_third_of_rows_on_one_key(spark, folder):
    random.seed(1)
    keys = [500] * 200 + [random.randrange(1000) for _ in range(400)]
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").write.parquet(folder + "/t")
    df = spark.read.parquet(folder + "/t")
    for n in (0, 5, 150, 300, 599, 600, 700):
        got = first_by_key(df, "k", n)
        assert sorted(r.k for r in got.collect()) == sorted(keys)[:n]
        assert got.select("i").distinct().count() == min(n, 600)


def test_first_by_key_takes_null_keys_last(spark, folder):
    spark.createDataFrame([(3,), (None,), (1,), (None,)], "k long").write.parquet(folder + "/t")
    df = spark.read.parquet(folder + "/t")
    assert [r.k for r in first_by_key(df, "k", 2).collect()].count(None) == 0
    assert sorted((r.k for r in first_by_key(df, "k", 3).collect()), key=str) == [1, 3, None]
    with pytest.raises(TypeError):
        first_by_key(df.select(F.col("k").cast("string").alias("k")), "k", 2)


def test_preview_is_a_top_k(spark):
    df = preview(spark.range(1000), ["id"], 5)
    assert [r.id for r in df.collect()] == [0, 1, 2, 3, 4]
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()
