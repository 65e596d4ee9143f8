from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.plans import training
from tablewright.plans.training import (
    CODE,
    PREDICTED,
    ClassTask,
    NumberTask,
    TreeSettings,
    class_labels,
    load_model,
    save_model,
    number_errors,
    prepare_numbers,
    save_predictions,
    score,
    score_accuracy,
    score_numbers,
    train,
    train_numbers,
)
from tablewright.schemas import FLOWER_FEATURES, FLOWER_KEY, FLOWER_LABEL
from tablewright.sources.objects import ObjectTable, read_object
from tests.conftest import rows

TREES = TreeSettings(rounds=4, depth=3)
TASK = ClassTask([FLOWER_KEY], FLOWER_FEATURES, FLOWER_LABEL, trees=TREES)


@pytest.fixture(scope="module")
def flowers(spark):
    """Three species told apart by petal length; ids are text, one flag is boolean text."""
    i = F.col("id")
    kind = F.when(i % 3 == 0, "setosa").when(i % 3 == 1, "versicolor").otherwise("virginica")
    return spark.range(600).select(
        F.concat(F.lit("f"), i.cast("string")).alias(FLOWER_KEY),
        F.lit("FALSE").alias("is_deleted"),
        (F.lit(5.0) + (i % 7) / 10).alias("sepal_length_cm"),
        (F.lit(3.0) + (i % 5) / 10).alias("sepal_width_cm"),
        (F.lit(1.5) + (i % 3) * 2 + (i % 11) / 20).alias("petal_length_cm"),
        (F.lit(0.2) + (i % 3) * 0.8).cast("string").alias("petal_width_cm"),
        kind.alias(FLOWER_LABEL),
    )


@pytest.fixture(scope="module")
def model(spark, flowers):
    return train(flowers, TASK)


def test_scores_cover_all_rows_and_hit(spark, flowers, model):
    scored = score(model, flowers, TASK, nearest=True)
    assert scored.count() == 600 and class_labels(model) == ["setosa", "versicolor", "virginica"]
    shares = {r.split: (r.rows, r.accuracy) for r in score_accuracy(scored).collect()}
    assert shares["train"][0] + shares["test"][0] == shares["all"][0] == 600
    assert min(a for _, a in shares.values()) > 0.95
    wrong = scored.filter(F.col(FLOWER_LABEL) != F.col(f"predicted_{FLOWER_LABEL}")).count()
    assert wrong < 30


def test_truncation_never_exceeds_the_raw_value(flowers, model):
    scored = score(model, flowers, TASK)
    assert scored.filter((F.col(PREDICTED) > F.col("raw_prediction")) & (F.col("raw_prediction") >= 0)).count() == 0


def test_codes_do_not_depend_on_what_is_scored(flowers, model):
    """Only one class among the scored rows: its code stays the one it was trained with."""
    one = flowers.filter(F.col(FLOWER_LABEL) == "virginica")
    assert rows(score(model, one, TASK).select(CODE).distinct()) == [(2,)]


def test_unknown_classes_have_no_code(flowers, model):
    odd = flowers.limit(3).withColumn(FLOWER_LABEL, F.lit("rose"))
    assert rows(score(model, odd, TASK).select(CODE).distinct()) == [(None,)]
    unlabelled = flowers.limit(3).withColumn(FLOWER_LABEL, F.lit(None).cast("string"))
    assert rows(score(model, unlabelled, TASK).select(CODE).distinct()) == [(None,)]
    assert rows(score(model, unlabelled.drop(FLOWER_LABEL), TASK)) == rows(score(model, unlabelled, TASK))


def test_reloaded_model_scores_the_same(spark, flowers, model, folder):
    save_model(model, folder + "/m")
    assert rows(score(load_model(folder + "/m"), flowers, TASK)) == rows(score(model, flowers, TASK))


def test_predictions_go_to_their_own_table(spark, flowers, model, folder):
    store = ObjectTable(folder, "g", "a", "predictions")
    assert save_predictions(score(model, flowers, TASK), TASK, store).rows == 600
    back = read_object(spark, store)
    assert back.columns == [FLOWER_KEY, *FLOWER_FEATURES, FLOWER_LABEL]
    assert back.schema[FLOWER_LABEL].dataType.simpleString() == "int"


def test_spreading_small_sources_changes_nothing_else(flowers, model):
    from dataclasses import replace

    few = flowers.coalesce(1)
    again = train(few, replace(TASK, trees=replace(TREES, least_partitions=4)))
    assert class_labels(again) == class_labels(model)
    assert min(r.accuracy for r in score_accuracy(score(again, few, TASK, nearest=True)).collect()) > 0.95


def test_unlabelled_rows_are_not_trained_on(flowers, model):
    extra = flowers.limit(5).withColumn(FLOWER_LABEL, F.lit(None).cast("string"))
    again = train(flowers.unionByName(extra), TASK)
    assert class_labels(again) == class_labels(model)


def test_regression_with_gaps(spark):
    i = F.col("id")
    houses = spark.range(800).select(
        i.alias("Id"),
        F.when(i % 10 != 0, (i % 50).cast("double")).alias("LotArea"),
        (i % 2 == 0).alias("CentralAir"),
        F.lit("brick").alias("Exterior"),
        F.lit(None).cast("double").alias("PoolArea"),
        F.when(i % 20 != 3, (i % 50) * 1000.0 + F.when(i % 2 == 0, 5000.0).otherwise(0.0)).alias("SalePrice"),
    )
    task = NumberTask(["Id"], "SalePrice", seed=1, trees=TREES)
    prepared, names = prepare_numbers(houses, task)
    assert names == ["LotArea", "CentralAir"] and prepared.columns == ["Id", "LotArea", "CentralAir", "SalePrice", "split"]
    model, prepared = train_numbers(houses, task)
    scored = score_numbers(model, prepared)
    assert scored.columns == ["Id", "LotArea", "CentralAir", "SalePrice", "split", "raw_prediction"]
    errors = {r.split: (r.rows, r.mae) for r in number_errors(scored, task).collect()}
    assert errors["all"][0] == 760 and errors["test"][1] < 6000
    assert abs(errors["test"][0] / 760 - 0.25) < 0.06


def test_partitions_of_the_fit_grow_with_the_training_rows(spark, flowers, monkeypatch):
    """No task of the fit holds more than ``ROWS_PER_TASK`` rows or so."""
    wanted = []
    spread = type(flowers).repartition

    def noted(df, n, *columns):
        wanted.append(n)
        return spread(df, n, *columns)

    monkeypatch.setattr(training, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(type(flowers), "repartition", noted)
    task = ClassTask([FLOWER_KEY], FLOWER_FEATURES, FLOWER_LABEL, trees=TreeSettings(rounds=1, depth=1, least_partitions=2))
    train(flowers, task)
    assert wanted == [12]
    numbers = NumberTask([FLOWER_KEY], "petal_length_cm", seed=3, trees=TreeSettings(rounds=1, depth=1, least_partitions=20))
    train_numbers(flowers, numbers)
    assert wanted == [12, 20]
