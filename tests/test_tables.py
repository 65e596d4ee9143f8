from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import sizes
from tablewright.operators.tables import (
    append_rows,
    assign_ids,
    classify,
    _ranges,
    dense_ids,
    extend_versions,
    latest_per_key,
    merge_snapshot,
    replace_snapshot,
    upsert,
    versions,
)
from tests.conftest import plan, rows

FEED = "k string, batch int, v int"


def skewed(spark, n=3000):
    """A third of the rows on one key, some of them copies."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string"))
    return spark.range(n).select(key.alias("k"), (F.col("id") % 17).cast("int").alias("batch"), (F.col("id") % 5).cast("int").alias("v"))


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 2, 2), ("a", 1, 3), ("b", 0, 4), (None, 0, 5), (None, 1, 6)], FEED)
    assert rows(latest_per_key(df, ["k"])) == [("a", 2, 2), ("b", 0, 4), (None, 0, 5), (None, 1, 6)]


def test_ties_resolve_the_same_way_whatever_the_order(spark):
    df = skewed(spark)
    assert rows(latest_per_key(df, ["k"])) == rows(latest_per_key(df.repartition(9), ["k"]))


def test_a_frequent_key_is_thinned_before_the_shuffle(spark):
    text = plan(latest_per_key(skewed(spark), ["k"]))
    shuffle = text.index("Exchange hashpartitioning")
    assert text.index("WindowGroupLimit", shuffle) > shuffle and "Partial" in text[shuffle:]


def test_upsert_and_merge(spark):
    table = spark.createDataFrame([("a", -1, 1), ("z", -1, 9)], FEED)
    feed = spark.createDataFrame([("a", 0, 2), ("b", 0, 3), ("b", 1, 4)], FEED)
    want = [("a", 0, 2), ("b", 1, 4), ("z", -1, 9)]
    assert rows(upsert(table, feed, ["k"])) == rows(merge_snapshot(table, feed, ["k"])) == want
    assert rows(upsert(None, feed, ["k"])) == want[:2]


@pytest.mark.parametrize("bytes_allowed", [0, 1 << 20])
def test_a_following_batch_leaves_unchanged_rows_where_they_are(spark, folder, monkeypatch, bytes_allowed):
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", bytes_allowed)
    spark.createDataFrame([("a", -1, 1), ("z", -1, 9), (None, -1, 7)], FEED).write.parquet(folder + "/t")
    table = spark.read.parquet(folder + "/t")
    feed = spark.createDataFrame([("a", 0, 2), ("b", 0, 3), ("b", 1, 4), (None, 1, 8)], FEED)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = upsert(table, feed, ["k"], follows=True)
        assert rows(got) == rows(upsert(table, feed, ["k"]))
        assert ("BroadcastHashJoin" in plan(got)) == (bytes_allowed > 0)
        assert ("Exchange hashpartitioning" in plan(got)) == (bytes_allowed == 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_measuring_before_broadcasting(spark):
    df = spark.createDataFrame([("abc", None), ("é", 10)], "s string, n int")
    assert sizes.content_bytes(df) == 2 * 2 * 16 + 3 + 2 + 2
    assert sizes.content_bytes(df.limit(0)) == 0
    assert sizes.broadcast_if_small(df, 10) is df


def test_batches_applied_one_by_one_or_at_once(spark):
    feed = skewed(spark).withColumn("v", F.col("batch"))
    stepwise = None
    for number in range(0, 17, 4):
        part = feed.filter(F.col("batch").between(number, number + 3))
        stepwise = upsert(stepwise, part, ["k"], follows=True)
    assert rows(stepwise) == rows(upsert(None, feed, ["k"]))


def test_append_keeps_everything(spark):
    feed = spark.createDataFrame([("a", 0, 2)], FEED)
    assert append_rows(feed, feed).count() == 2


def test_replace_snapshot_reads_the_last_batch_only(spark, folder):
    skewed(spark).write.partitionBy("batch").parquet(folder + "/feed")
    last = replace_snapshot(spark.read.parquet(folder + "/feed"))
    assert rows(last.select("batch").distinct()) == [(16,)]
    assert re.search(r"PartitionFilters: \[isnotnull\(batch#\d+\), \(batch#\d+ = 16\)\]", plan(last))
    assert replace_snapshot(spark.createDataFrame([], FEED)).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_dense_ids_follow_the_order(spark, folder, partitions):
    spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(6).write.parquet(folder + "/t")
    got = dense_ids(spark.read.parquet(folder + "/t"), ["x"], "n", start=11, partitions=partitions)
    assert rows(got) == sorted(((x, x + 11) for x in range(1000)), key=repr)


def test_dense_ids_of_copies(spark, folder):
    """A third of the rows are one row; every id is given once."""
    spark.range(900).select(F.when(F.col("id") < 300, F.lit(5)).otherwise(F.col("id")).alias("x")).write.parquet(folder + "/t")
    got = dense_ids(spark.read.parquet(folder + "/t"), ["x"], "n", partitions=8).collect()
    assert sorted(r.n for r in got) == list(range(1, 901))
    assert [r.x for r in sorted(got, key=lambda r: r.n)] == sorted(r.x for r in got)


def test_dense_ids_of_copies_spread_over_tasks(spark, folder):
    spark.range(4000).select(F.lit(5).alias("x")).repartition(4).write.parquet(folder + "/t")
    got = dense_ids(spark.read.parquet(folder + "/t"), ["x"], "n", partitions=8)
    largest = got.groupBy((F.col("n") > 0).alias("any")).count().first()["count"]
    assert largest == 4000
    parts = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()})
    assert parts.groupBy("__part").count().agg(F.max("count")).first()[0] < 1500


def test_dense_ids_of_nothing(spark):
    got = dense_ids(spark.range(0), ["id"], "n")
    assert got.columns == ["id", "n"] and got.count() == 0


def test_dense_ids_compute_their_input_once(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = dense_ids(spark.range(1_000).mapInArrow(counted, "id long"), ["id"], "n", start=0)
    assert got.filter("n <> id").count() == 0 and seen.value == 1_000


def test_partitions_follow_the_rows(spark):
    assert [_ranges(spark.range(0), n) for n in (0, 1, 50_000, 50_001, 10**6, 10**8)] == [1, 1, 1, 2, 4, 50]


def test_assign_ids(spark):
    feed = spark.createDataFrame(
        [("", 0, 30), (None, 0, 10), (" ", 0, 20), ("2", 1, 21), ("", 1, 40), ("2", 2, 22)], "id string, batch int, v int"
    )
    got = assign_ids(None, feed, "id", ["v"])
    assert sorted((r.id, r.batch, r.v) for r in got.collect()) == [(1, 0, 10), (2, 2, 22), (3, 0, 30), (4, 1, 40)]


def test_assign_ids_goes_on_above_the_table(spark):
    table = spark.createDataFrame([(5, -1, 1), (9, -1, 2)], "id long, batch int, v int")
    feed = spark.createDataFrame([("", 0, 3), ("5", 0, 4)], "id string, batch int, v int")
    got = assign_ids(table, feed, "id", ["v"])
    want = [(5, 0, 4), (9, -1, 2), (10, 0, 3)]
    assert sorted((r.id, r.batch, r.v) for r in got.collect()) == want
    after = assign_ids(table, feed, "id", ["v"], follows=True)
    assert sorted((r.id, r.batch, r.v) for r in after.collect()) == want


def by_hand(feed):
    """Versions in plain Python: per key, sorted batches, next one as the end."""
    batches = {}
    for k, b in feed:
        batches.setdefault(k, set()).add(b)
    out = []
    for k, found in batches.items():
        ordered = sorted(found)
        out += [(k, b, nxt) for b, nxt in zip(ordered, [*ordered[1:], None])]
    return sorted(out, key=repr)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 30)), min_size=1, max_size=30), st.integers(1, 9))
def test_versions_in_pieces(spark, feed, piece):
    df = spark.createDataFrame([(k, b, 0) for k, b in feed], FEED)
    got = versions(df, ["k"], piece=piece)
    assert sorted(((r.k, r.valid_from, r.valid_to) for r in got.collect()), key=repr) == by_hand(feed)


def test_versions_of_a_known_number_of_batches(spark):
    feed = [("a", 0), ("a", 3), ("b", 1)]
    df = spark.createDataFrame([(k, b, 0) for k, b in feed], FEED)
    got = versions(df, ["k"], batches=4, unique=True)
    assert sorted(((r.k, r.valid_from, r.valid_to) for r in got.collect()), key=repr) == by_hand(feed)
    assert plan(got).count("Exchange hashpartitioning") == 1


def test_versions_of_batches_far_apart(spark):
    """A frequent key with sparse batch numbers: pieces have as many rows as they may, heads are few."""
    df = spark.range(2_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), (F.col("id") * 1_000_000).alias("batch"), F.lit(0).alias("v"))
    got = versions(df, ["k"], piece=64)
    assert sorted((r.k, r.valid_from, r.valid_to or -1) for r in got.collect()) == sorted((k, b, e or -1) for k, b, e in by_hand([(r.k, r.batch) for r in df.collect()]))
    assert "Window [lead(__n" in plan(got) and "hashpartitioning(k" not in plan(got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 30)), min_size=1, max_size=25), st.integers(0, 30))
def test_versions_extended_by_later_batches(spark, feed, cut):
    df = spark.createDataFrame([(k, b, 0) for k, b in feed], FEED)
    first, second = df.filter(F.col("batch") < cut), df.filter(F.col("batch") >= cut)
    got = extend_versions(versions(first, ["k"]), second, ["k"])
    assert sorted(((r.k, r.valid_from, r.valid_to) for r in got.collect()), key=repr) == by_hand(feed)


def test_many_changed_keys_read_only_their_range(spark, folder, monkeypatch):
    """Beyond what may be broadcast, bounds of the changed keys reach the scan of a table in key order."""
    spark.range(10_000).select("id", F.lit(0).alias("batch")).repartitionByRange(8, "id").write.parquet(folder + "/t")
    table = spark.read.parquet(folder + "/t")
    feed = spark.createDataFrame([(i, 1) for i in (4_000, 4_500, 20_000)] + [(None, 1)], "id long, batch int")
    want = rows(upsert(table, feed, ["id"], follows=True))
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = upsert(table, feed, ["id"], follows=True)
        assert rows(got) == want and len(want) == 10_002
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(id,4000)" in text and "LessThan(id,4000)" in text and "GreaterThan(id,20000)" in text
        nobody = feed.filter("id is null")
        assert upsert(table, nobody, ["id"], follows=True).count() == 10_001
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_with_copies_and_a_frequent_key(spark):
    df = skewed(spark)
    got = versions(df, ["k"], piece=4)
    want = by_hand([(r.k, r.batch) for r in df.collect()])
    assert sorted(((r.k, r.valid_from, r.valid_to) for r in got.collect()), key=repr) == want
    assert rows(got) == rows(versions(df, ["k"], batches=17))


@pytest.mark.parametrize("hot_rows", [1, 3, 100, 10_000])
def test_classify(spark, hot_rows):
    df = skewed(spark).unionAll(spark.createDataFrame([(None, 1, 0), (None, 2, 0)], FEED))
    first = {}
    for r in df.collect():
        first[r.k] = min(r.batch, first.get(r.k, r.batch))
    want = sorted(((r.k, r.batch, r.v, "I" if r.batch == first[r.k] else "U") for r in df.collect()), key=repr)
    assert rows(classify(df, ["k"], hot_rows=hot_rows)) == want


def test_rows_of_a_frequent_key_are_not_shuffled(spark, folder):
    skewed(spark).write.parquet(folder + "/t")
    text = plan(classify(spark.read.parquet(folder + "/t"), ["k"], hot_rows=100))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "CartesianProduct" not in text
