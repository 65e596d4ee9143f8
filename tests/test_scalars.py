from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions.keyed import check_hash_keys, key_digest, share_threshold, uniform_int, with_words
from tablewright.functions.scalars import (
    batch_suffix,
    blank,
    external_id,
    id_number,
    nearest_code,
    null_double,
    truncated,
)
from tablewright.operators.shaping import features_to_double


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_ids(spark):
    assert one(spark, external_id(F.lit(7)), id_number(F.lit("ext_7")), id_number(F.lit("ext")), blank()) == (
        "ext_7", "7", None, "",
    )
    assert one(spark, id_number(F.lit("a_b_c")), id_number(F.lit("_x")), id_number(F.lit(None).cast("string"))) == (
        "b", "x", None,
    )


@pytest.mark.parametrize("number, text", [(0, "000"), (9, "009"), (10, "010"), (99, "099"), (100, "100"), (1234, "1234")])
def test_suffix_pads_and_keeps_long_numbers(spark, number, text):
    assert one(spark, batch_suffix(F.lit(number))) == (text,)


@pytest.mark.parametrize("value, code", [(-0.9, 0), (0.99, 0), (1.99, 1), (2.5, 2), (-1.5, -1)])
def test_truncation_is_toward_zero(spark, value, code):
    assert one(spark, truncated(F.lit(value))) == (code,)


@pytest.mark.parametrize("value, code", [(-3.0, 0), (0.49, 0), (0.5, 1), (1.99, 2), (9.0, 2)])
def test_nearest_code_stays_in_range(spark, value, code):
    assert one(spark, nearest_code(F.lit(value), 3)) == (code,)


def test_null_double(spark):
    df = spark.range(1).select(null_double().alias("x"))
    assert df.schema["x"].dataType.simpleString() == "double" and df.first().x is None


def test_text_to_double(spark):
    df = spark.createDataFrame([("TRUE", "1.5", True), (" false ", "x", False), (None, None, None)], "a string, b string, c boolean")
    out = features_to_double(df, ["a", "b", "c"], strict=False).collect()
    assert [tuple(r) for r in out] == [(1.0, 1.5, 1.0), (0.0, None, 0.0), (None, None, None)]


def test_strict_cast_refuses_other_text(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(PySparkException):
        features_to_double(df, ["a"]).collect()


def test_uniform_int_covers_its_range_only(spark):
    words = [F.col(c) for c in "abc"]
    df = with_words(spark.range(400), "id", 1, ["a", "b", "c"])
    for draw in (1, 2, 20):
        assert {r[0] for r in df.select(uniform_int(words, draw, 3, 9)).collect()} == set(range(3, 10))
    with pytest.raises(ValueError):
        uniform_int(words, 1, 2, 1)


def test_uniform_int_is_even(spark):
    df = with_words(spark.range(1 << 40, (1 << 40) + 20_000), "id", 1, ["a", "b", "c"])
    for draw in (1, 5, 18):
        value = uniform_int([F.col(c) for c in "abc"], draw, 1, 10).alias("v")
        pairs = df.select(value, F.lag(value).over(Window.orderBy("id")).alias("before"))
        counts = [r["count"] for r in pairs.groupBy("v").count().collect()]
        assert len(counts) == 10 and all(abs(c - 2000) < 200 for c in counts)
        assert 1_800 < pairs.filter("v = before").count() < 2_200  # neighbours are not alike


def test_share_threshold():
    assert share_threshold(0.2) == "33333333"
    assert share_threshold(0.25) == "40000000"
    for bad in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            share_threshold(bad)


def test_digest_separates_keys_and_refuses_floats(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "")], "x string, y string")
    digests = [r[0] for r in df.select(key_digest(["x", "y"], 0)).collect()]
    assert len(set(digests)) == 3
    with pytest.raises(TypeError):
        check_hash_keys(spark.range(1).select(F.lit(1.0).alias("d")), ["d"])
    with pytest.raises(ValueError):
        check_hash_keys(df, [])
