from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators.feeds import FeedSpec, ObjectType, batch_by_ranges, batch_counts, change_feed, feed_slots, file_name, require_pool
from tablewright.plans.queries import QUERIES
from tablewright.schemas import FACT_COLUMNS, FACT_RANGES
from tablewright.sinks.text import write_feed_csv
from tablewright.sources.facts import generate_facts, generate_feed
from tablewright.sources.text import read_feed_csv
from tests.conftest import plan, rows

EXTERNAL = ObjectType.STANDARD_WITH_EXTERNAL_ID


def spec(f, r, i, u, kind=EXTERNAL, **more):
    if ObjectType(kind).has_candidate_key:
        more.setdefault("candidate_keys", ("MARKET_ID",))
    return FeedSpec("p", kind, f, r, i, u, **more)


def expected(f, r, i, u):
    """Batch by batch: (index, batch, op)."""
    out, last = [(x, 0, "I") for x in range(1, r + 1)], r
    for batch in range(1, f):
        out += [(x, batch, "I") for x in range(last + 1, last + i + 1)]
        out += [(x, batch, "U") for x in range(last - u + 1, last + 1)]
        last += i
    return sorted(out)


def indexed(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("ix"), (F.col("id") * 10).alias("TOTAL_AMOUNT"), F.col("id").alias("MARKET_ID"))


def placed(df):
    return sorted((r.MARKET_ID, r.batch, r.op) for r in df.collect())


@pytest.mark.parametrize("f, r, i, u", [(3, 5, 2, 3), (3, 4, 0, 4), (3, 4, 4, 0), (1, 4, 1, 3), (6, 7, 1, 6), (2, 1, 0, 1)])
def test_feed_follows_the_batches(spark, f, r, i, u):
    df = change_feed(indexed(spark, 200), "ix", spec(f, r, i, u))
    assert placed(df) == expected(f, r, i, u)


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 6), st.integers(1, 12), st.data())
def test_feed_properties(spark, f, r, data):
    i = data.draw(st.integers(0, r))
    s = spec(f, r, i, r - i)
    got = placed(change_feed(indexed(spark, 100), "ix", s))
    assert got == expected(f, r, i, r - i)
    assert len(got) == f * r == s.feed_rows
    assert len({x for x, _, _ in got}) == s.pool_rows
    assert len([x for x, _, op in got if op == "I"]) == s.pool_rows


def test_one_batch_by_ranges_is_that_batch_of_the_feed(spark):
    for kind in ObjectType:
        for i, u in ((2, 3), (0, 5), (5, 0)):
            s = spec(4, 5, i, u, kind)
            whole = change_feed(indexed(spark, 100), "ix", s)
            for batch in range(4):
                one = batch_by_ranges(indexed(spark, 100), "ix", s, batch)
                assert one.columns == whole.columns
                assert rows(one) == rows(whole.filter(F.col("batch") == batch))


def test_standard_blanks_inserts_and_numbers_updates(spark):
    df = change_feed(indexed(spark, 50), "ix", spec(2, 4, 1, 3, ObjectType.STANDARD))
    assert df.columns == ["TOTAL_AMOUNT", "MARKET_ID", "p_id", "batch", "op"]
    ids = {(r.MARKET_ID, r.batch): r.p_id for r in df.collect()}
    assert ids == {(1, 0): "", (2, 0): "", (3, 0): "", (4, 0): "", (5, 1): "", (2, 1): "2", (3, 1): "3", (4, 1): "4"}


@pytest.mark.parametrize("kind", [t for t in ObjectType if t.has_external_id])
def test_external_ids_are_resent_unchanged(spark, kind):
    df = change_feed(indexed(spark, 50), "ix", spec(3, 4, 1, 3, kind))
    assert df.columns[-3] == "p_external_id"
    for r in df.collect():
        assert r.p_external_id == f"ext_{r.MARKET_ID}" and r.TOTAL_AMOUNT == 10 * r.MARKET_ID


@pytest.mark.parametrize("kind", [t for t in ObjectType if t.has_candidate_key])
def test_candidate_keys_shift_after_the_seed(spark, kind):
    df = change_feed(indexed(spark, 50), "ix", spec(2, 4, 1, 3, kind))
    assert df.columns == ["TOTAL_AMOUNT", "MARKET_ID", "batch", "op"]
    got = sorted((r.batch, r.op, r.MARKET_ID, r.TOTAL_AMOUNT) for r in df.collect())
    seed = [(0, "I", k, 10 * k) for k in (1, 2, 3, 4)]
    assert got == seed + [(1, "I", 6, 50)] + [(1, "U", k, 10 * k + 1) for k in (2, 3, 4)]


def test_several_candidate_keys_may_be_spaced(spark):
    df = indexed(spark, 9).withColumn("CHANNEL_ID", F.lit(1))
    s = spec(2, 2, 1, 1, ObjectType.COMPLETE_SNAPSHOT, candidate_keys=(" MARKET_ID", "CHANNEL_ID "))
    insert = change_feed(df, "ix", s).filter("batch = 1 AND op = 'I'").first()
    assert (insert.MARKET_ID, insert.CHANNEL_ID) == (4, 2)


@pytest.mark.parametrize(
    "arguments",
    [
        ("", EXTERNAL, 2, 4, 1, 3), ("p", EXTERNAL, 0, 4, 1, 3), ("p", EXTERNAL, 2, 0, 0, 0),
        ("p", EXTERNAL, 2, 4, 1, 2), ("p", EXTERNAL, 2, 4, -1, 5), ("p", "no_such_type", 2, 4, 1, 3),
        ("p", ObjectType.COMPLETE_SNAPSHOT, 2, 4, 1, 3),
    ],
)
def test_impossible_feeds_are_refused(arguments):
    with pytest.raises(ValueError):
        FeedSpec(*arguments)


def test_blank_candidate_keys_are_no_keys():
    with pytest.raises(ValueError):
        FeedSpec("p", ObjectType.INCREMENTAL_SNAPSHOT, 2, 4, 1, 3, candidate_keys=("", " "))


def test_pool_check(spark):
    s = spec(3, 5, 2, 3)
    assert require_pool(indexed(spark, 9), "ix", s) == 9
    pools = [range(1, 9), [*range(1, 10), 9], [1, 3, 3, 4, 4, 5, 8, 8, 9], [1] * 9, [], [1, 2, 3, 4, 5, 6, 7, 8, None]]
    for pool in pools:  # the third has the count, ends, sum and sum of squares of a whole one
        df = spark.createDataFrame([(i,) for i in pool], "ix long")
        with pytest.raises(ValueError, match="each once"):
            require_pool(df, "ix", s)
        with pytest.raises(ValueError, match="each once"):
            change_feed(df.selectExpr("ix", "ix AS TOTAL_AMOUNT"), "ix", s)
    big = spec(2, 1_000, 500, 500)
    assert require_pool(spark.range(-7, 5_000), "id", big, start=100) == 1_500
    with pytest.raises(ValueError):
        require_pool(spark.range(0, 5_000).filter("id <> 1599"), "id", big, start=100)


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 6), st.integers(1, 12), st.integers(1, 5), st.data())
def test_places_of_a_feed_lead_back_to_its_rows(spark, f, r, partitions, data):
    i = data.draw(st.integers(0, r))
    slots = feed_slots(spark, spec(f, r, i, r - i), partitions)
    assert sorted((x.position, x.batch, x.op) for x in slots.collect()) == expected(f, r, i, r - i)


def test_a_generated_feed_is_that_of_its_pool(spark):
    for kind in ObjectType:
        s = spec(4, 30, 11, 19, kind)
        pool = generate_facts(spark, s.pool_rows, seed=4)
        feed = generate_feed(spark, s, seed=4, partitions=3)
        assert feed.columns == change_feed(pool, "MARKET_ID", s, start=0, keep_index=True).columns
        assert rows(feed) == rows(change_feed(pool, "MARKET_ID", s, start=0, keep_index=True))
    text = plan(feed)
    assert "Generate" not in text and "Exchange" not in text


@pytest.mark.parametrize("kind", list(ObjectType))
def test_files_lead_back_to_the_feed(spark, folder, kind):
    s = spec(3, 20, 8, 12, kind)
    pool = indexed(spark, s.pool_rows).withColumn("note", F.expr("CASE ix % 3 WHEN 0 THEN '' WHEN 1 THEN 'a\"b,' END"))
    feed = change_feed(pool, "ix", s)
    write_feed_csv(feed, folder + "/feed", s, operations=True)
    assert rows(read_feed_csv(spark, folder + "/feed", s, feed.schema, operations=True)) == rows(feed)
    write_feed_csv(feed, folder + "/feed", s, gather=True)
    back = read_feed_csv(spark, folder + "/feed", s, feed.schema)
    assert back.columns == [c for c in feed.columns if c != "op"] and rows(back) == rows(feed.drop("op"))


def test_folders_of_another_feed_are_refused(spark, folder):
    s = spec(2, 4, 1, 3)
    feed = change_feed(indexed(spark, 50), "ix", s)
    write_feed_csv(feed, folder + "/feed", s)
    with pytest.raises(Exception, match="not a batch of this feed"):
        read_feed_csv(spark, folder + "/feed", spec(2, 5, 1, 4), feed.schema).collect()


def test_files_are_as_many_as_batches_and_tasks(spark, folder):
    s = spec(6, 500, 200, 300)
    write_feed_csv(generate_feed(spark, s, partitions=4), folder + "/feed", s)
    assert len(spark.read.csv(folder + "/feed").inputFiles()) <= 6 + 4
    mixed = indexed(spark, s.pool_rows).repartition(4)
    write_feed_csv(change_feed(mixed, "ix", s), folder + "/mixed", s, gather=True)
    assert len(spark.read.csv(folder + "/mixed").inputFiles()) <= 6 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_feed_is_one_narrow_pass(spark):
    text = plan(change_feed(indexed(spark, 50), "ix", spec(3, 5, 2, 3)))
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


def test_file_names(spark):
    got = spark.createDataFrame([(0,), (7,), (1234,)], "b int").select(file_name(F.col("b"), spec(3, 5, 2, 3)))
    assert [r[0] for r in got.collect()] == ["p_5_000", "p_5_007", "p_5_1234"]


def test_facts(spark):
    df = generate_facts(spark, 3000, seed=1)
    assert df.columns == FACT_COLUMNS and df.count() == 3000
    bounds = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in FACT_RANGES]).first().asDict()
    for name, limits in FACT_RANGES.items():
        low, high = tuple(bounds[name])
        assert (low, high) == (0, 2999) if limits is None else limits[0] <= low <= high <= limits[1]
    assert tuple(bounds["PRODUCT_ID"]) == (1, 7) and tuple(bounds["NRX"])[1] > 990
    assert rows(df.select("IS_DELETED").distinct()) == [("FALSE",)]
    assert rows(df) == rows(generate_facts(spark, 3000, seed=1, partitions=3))
    assert rows(df.limit(50)) != rows(generate_facts(spark, 3000, seed=2).limit(50))
    assert generate_facts(spark, 0).count() == 0


def test_own_draws_do_not_follow_from_each_other(spark):
    df = generate_facts(spark, 2000, seed=11, own_draws=True)
    assert df.columns == FACT_COLUMNS and df.schema == generate_facts(spark, 0).schema
    low = {name: limits[0] for name, limits in FACT_RANGES.items() if limits == (100, 1000)}
    four = [F.col(name) - low[name] for name in list(low)[:4]]
    line = (four[3] - 3 * four[2] + 3 * four[1] - four[0]) % 901 == 0
    assert df.filter(line).count() < 20  # of a quadratic's values, all
    assert generate_facts(spark, 2000, seed=11).filter(line).count() == 2000
    assert rows(df) == rows(generate_facts(spark, 2000, seed=11, partitions=3, own_draws=True))


def test_sized_facts_have_a_draw_for_every_cell(spark, folder):
    spark.range(500).write.parquet(f"{folder}/lineitem.parquet")

    def draw(row, block, slot, low, high):
        return low + int(hashlib.md5(f"{row}:{block}:11".encode()).hexdigest()[8 * slot:8 * slot + 8], 16) % (high - low + 1)

    want = {}
    for row in range(500):
        product = draw(row, 0, 0, 1, 7)
        size, customers, amount, _ = want.get(product, (0, 0, 0, 0))
        want[product] = (size + 1, customers + draw(row, 0, 2, 100, 100_000), amount + draw(row, 2, 0, 100, 1_000), row)
    assert rows(QUERIES["synthetic_fact_sized"](spark, folder)) == sorted((k, *v) for k, v in want.items())


def test_drawn_columns_are_not_copies_of_each_other(spark):
    df = generate_facts(spark, 2000, seed=5)
    drawn = [name for name, limits in FACT_RANGES.items() if limits == (100, 1000)]
    pairs = [(a, b) for n, a in enumerate(drawn) for b in drawn[n + 1:]]
    same = df.agg(*[F.avg((F.col(a) == F.col(b)).cast("int")).alias(f"{a}/{b}") for a, b in pairs]).first()
    assert max(same) < 0.02


def test_generated_feed_files(spark, folder):
    s = spec(3, 50, 20, 30, ObjectType.STANDARD)
    feed = generate_feed(spark, s, seed=3)
    assert feed.columns == [*FACT_COLUMNS, "p_id", "batch", "op"]
    write_feed_csv(feed, folder + "/feed", s)
    back = spark.read.option("header", True).csv(folder + "/feed")
    assert back.columns == [*FACT_COLUMNS, "p_id", "file"]
    assert rows(back.groupBy("file").count()) == [(f"p_50_00{b}", 50) for b in range(3)]
    assert rows(batch_counts(feed)) == [(0, "I", 50), (1, "I", 20), (1, "U", 30), (2, "I", 20), (2, "U", 30)]
