"""The four workloads from file to result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.operators.feeds import FeedSpec, ObjectType
from tablewright.operators.tables import assign_ids, upsert
from tablewright.plans.roundtrip import volume_grid
from tablewright.plans.training import ClassTask, NumberTask, TreeSettings
from tablewright.plans.workloads import feed_job, regression_job, score_job, store_rows, train_job, volume_run
from tablewright.schemas import FACTS, FLOWER_FEATURES, FLOWER_KEY, FLOWER_LABEL, VOLUME_COLUMNS
from tablewright.session import written
from tablewright.sinks.text import write_csv
from tablewright.sources.facts import generate_facts, generate_feed
from tablewright.sources.objects import ObjectTable, read_object
from tablewright.sources.text import read_csv
from tests.conftest import rows

TREES = TreeSettings(rounds=4, depth=3)


@pytest.fixture(scope="module")
def facts_csv(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "facts")
    write_csv(generate_facts(spark, 400, seed=2), path)
    return path


@pytest.mark.parametrize("kind", list(ObjectType))
def test_volume_run(spark, facts_csv, folder, kind):
    store = ObjectTable(folder, "g", "a", "sales")
    shaped = store_rows(spark, facts_csv, "sales", kind, schema=FACTS)
    lead = {ObjectType.STANDARD: ["sales_id"]}.get(kind, ["sales_external_id"] if kind.has_external_id else [])
    assert shaped.columns == [*lead, *VOLUME_COLUMNS]
    stats = volume_run(spark, facts_csv, store, kind, volume_grid(spark, 10, 2, 1), schema=FACTS)
    assert [(r.freq, r.record_count, r.iteration) for r in stats.collect()] == [(1, 10, 0), (1, 20, 0)]
    assert read_object(spark, store).count() == 30


@pytest.mark.parametrize("kind", [ObjectType.STANDARD, ObjectType.STANDARD_WITH_EXTERNAL_ID, ObjectType.COMPLETE_SNAPSHOT])
def test_volume_runs_share_parsed_rows(spark, facts_csv, folder, kind):
    """Runs over a frame store what runs over its path store; a row keeps its surrogate id in every cell."""
    facts, kept = written(read_csv(spark, facts_csv, FACTS), "facts"), []
    for source in (facts_csv, facts):
        store = ObjectTable(folder, "g", "a" if source is facts else "b", "sales")
        volume_run(spark, source, store, kind, [(1, 100, 0), (1, 400, 0)], schema=FACTS)
        kept.append(read_object(spark, store))
    assert kept[0].columns == kept[1].columns and [k.count() for k in kept] == [500, 500]
    payload = [kept[0].columns[-n] for n in range(1, len(VOLUME_COLUMNS) + 1)]
    assert rows(kept[1].select(*payload).distinct()) == rows(kept[0].select(*payload).distinct())
    if kind.has_external_id:
        assert kept[1].select("sales_external_id").distinct().count() == kept[1].distinct().count() == 400


def test_volume_run_by_type_parses_its_text_once(spark, monkeypatch):
    from tablewright.plans.queries import QUERIES, runs
    from tablewright.sources import text

    parsed, parse = [], read_csv

    def noted(spark, path, *more, **options):
        parsed.append(path)
        return parse(spark, path, *more, **options)

    for module in (text, runs):
        monkeypatch.setattr(module, "read_csv", noted, raising=False)
    orders = spark.range(40).select(F.col("id").alias("o_orderkey"))
    monkeypatch.setattr(runs, "table", lambda *_: orders)
    assert QUERIES["volume_run_by_type"](spark, "").count() == 2 * len(ObjectType)
    assert len(parsed) == 1


def test_train_then_score_from_text(spark, folder):
    i = F.col("id")
    flowers = spark.range(450).select(
        F.concat(F.lit("f"), i.cast("string")).alias(FLOWER_KEY),
        F.lit("FALSE").alias("is_deleted"),
        *[((i % 3) * (n + 1) + (i % 7) / 10).alias(c) for n, c in enumerate(FLOWER_FEATURES[1:])],
        F.element_at(F.array(*[F.lit(s) for s in ("setosa", "versicolor", "virginica")]), (i % 3 + 1).cast("int")).alias(FLOWER_LABEL),
    )
    write_csv(flowers, folder + "/flowers")
    source = read_csv(spark, folder + "/flowers", infer=False)
    task = ClassTask([FLOWER_KEY], FLOWER_FEATURES, FLOWER_LABEL, trees=TREES)
    train_job(source, task, folder + "/model")
    store = ObjectTable(folder, "g", "a", "predictions")
    done = score_job(source, task, folder + "/model", store, nearest=True)
    assert done.predictions.rows == 450
    assert done.accuracy["train"][0] + done.accuracy["test"][0] == done.accuracy["all"][0] == 450
    assert min(share for _, share in done.accuracy.values()) > 0.95
    assert rows(read_object(spark, store).groupBy(FLOWER_LABEL).count()) == [(0, 150), (1, 150), (2, 150)]


def test_feed_files_fill_the_same_table_as_the_feed(spark, folder):
    spec = FeedSpec("p", ObjectType.STANDARD_WITH_EXTERNAL_ID, 4, 100, 40, 60)
    feed_job(spark, spec, folder + "/feed", seed=9)
    back = spark.read.option("header", True).csv(folder + "/feed")
    batch = F.element_at(F.split("file", "_"), -1).cast("int")
    from_files = upsert(None, back.withColumn("batch", batch), ["p_external_id"])
    direct = upsert(None, generate_feed(spark, spec, seed=9), ["p_external_id"])
    columns = ["p_external_id", F.col("MARKET_ID").cast("long"), F.col("TOTAL_AMOUNT").cast("long"), "batch"]
    assert rows(from_files.select(*columns)) == rows(direct.select(*columns))
    assert from_files.count() == spec.pool_rows


def test_ids_assigned_from_a_feed_meet_its_updates(spark):
    """The feed numbers updates by position; dense ids in feed order are those positions."""
    spec = FeedSpec("p", ObjectType.STANDARD, 5, 50, 20, 30)
    table = assign_ids(None, generate_feed(spark, spec), "p_id", ["MARKET_ID"])
    assert table.filter(F.col("p_id") != F.col("MARKET_ID") + 1).count() == 0
    assert table.count() == spec.pool_rows


def test_regression_on_text_with_gaps(spark, folder):
    i = F.col("id")
    houses = spark.range(700).select(
        i.alias("Id"),
        F.when(i % 9 != 0, i % 40).alias("LotArea"),
        F.lit("brick").alias("Exterior"),
        F.when(i % 20 != 3, (i % 40) * 1000).alias("SalePrice"),
    )
    write_csv(houses, folder + "/houses", missing="NA")
    task = NumberTask(["Id"], "SalePrice", seed=1, trees=TREES)
    errors = {r.split: (r.rows, r.mae) for r in regression_job(spark, folder + "/houses", task).collect()}
    assert errors["all"][0] == 665 and errors["test"][1] < 5000
