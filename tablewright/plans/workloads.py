"""The four workloads end to end, each as one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.operators.feeds import FeedSpec, ObjectType
from tablewright.operators.measures import observed_accuracy
from tablewright.operators.ranking import first_rows
from tablewright.plans.roundtrip import run_volumes, shape_for_store
from tablewright.plans.training import (
    CODE,
    PREDICTED,
    SPLIT,
    TEST,
    TRAIN,
    ClassTask,
    NumberTask,
    load_model,
    number_errors,
    save_model,
    save_predictions,
    score,
    score_numbers,
    train,
    train_numbers,
)
from tablewright.schemas import VOLUME_COLUMNS
from tablewright.session import written
from tablewright.sinks.objects import Appended
from tablewright.sinks.text import write_feed_csv
from tablewright.sources.facts import generate_feed
from tablewright.sources.objects import ObjectTable
from tablewright.sources.text import for_store, read_csv, read_csv_for_store


def store_rows(spark: SparkSession, source: str | DataFrame, object_name: str, kind: ObjectType | str,
               columns: Sequence[str] = VOLUME_COLUMNS, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a CSV path, or of a frame read from one, in the shape a store of this type takes.

    Standard objects get an empty ``{object}_id`` in front, those with external ids a
    surrogate ``{object}_external_id``, the others neither.
    """
    kind = ObjectType(kind)
    standard = kind is ObjectType.STANDARD
    if isinstance(source, DataFrame):
        df = for_store(source, object_name, kind.has_external_id, standard)
    else:
        df = read_csv_for_store(spark, source, object_name, kind.has_external_id, standard, schema)
    ids = [f"{object_name}_id"] if standard else [f"{object_name}_external_id"] if kind.has_external_id else []
    return shape_for_store(df, [*ids, *columns])


def volume_run(spark: SparkSession, source: str | DataFrame, table: ObjectTable, kind: ObjectType | str,
               grid: Sequence[tuple[int, int, int]], columns: Sequence[str] = VOLUME_COLUMNS,
               schema: T.StructType | None = None) -> DataFrame:
    """CSV to an object table and back for every cell of the grid; one statistics row per run.

    As many shaped rows of a CSV path as the largest cell takes are written once, so that no
    cell is charged for parsing text. Where several runs share a source, parse and write it once
    before and give that frame: its rows are shaped as they are appended, nothing is written in between.
    """
    shaped = store_rows(spark, source, table.name, kind, columns, schema)
    if isinstance(source, DataFrame):
        return run_volumes(shaped, table, grid)
    most = max((n for _, n, _ in grid), default=0)
    return run_volumes(written(first_rows(shaped, most), "volume-rows"), table, grid)


@dataclass(frozen=True)
class Scored:
    """(rows, accuracy) per split and for ``all``, and the load that holds the predictions."""

    accuracy: dict[str, tuple[int, float | None]]
    predictions: Appended


def train_job(source: DataFrame, task: ClassTask, model_path: str) -> PipelineModel:
    """Fit on the training rows of a source and save the model."""
    model = train(source, task)
    save_model(model, model_path)
    return model


def score_job(source: DataFrame, task: ClassTask, model_path: str, table: ObjectTable, load: str | None = None,
              nearest: bool = False) -> Scored:
    """Score all rows with a saved model and append the predictions to their own table.

    Hits are counted while the predictions are written: rows are scored once.
    """
    scored = score(load_model(model_path), source, task, nearest)
    counted, result = observed_accuracy(scored, PREDICTED, CODE, SPLIT, (TRAIN, TEST))
    predictions = save_predictions(counted, task, table, load)
    return Scored(result(), predictions)


def feed_job(spark: SparkSession, spec: FeedSpec, path: str, seed: int = 0) -> None:
    """Generate a change feed and write its numbered batches as CSV."""
    write_feed_csv(generate_feed(spark, spec, seed), path, spec)


def regression_job(spark: SparkSession, path: str, task: NumberTask, missing: str = "NA",
                   schema: T.StructType | None = None) -> DataFrame:
    """Errors per split of a regression on a CSV file with gaps."""
    model, prepared = train_numbers(read_csv(spark, path, schema, missing=missing), task)
    return number_errors(score_numbers(model, prepared), task)
