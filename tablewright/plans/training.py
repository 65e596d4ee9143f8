"""Train and score boosted regression trees on encoded class labels, or on a number."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.scalars import nearest_code, truncated
from tablewright.operators.filters import labelled
from tablewright.operators.labels import label_list
from tablewright.operators.measures import accuracy, mean_absolute_error
from tablewright.operators.missing import fit_means
from tablewright.operators.shaping import features_to_double, numeric_columns, reorder
from tablewright.operators.splits import keyed_split
from tablewright.session import ensure_checkpoint_dir
from tablewright.sinks.objects import Appended, append
from tablewright.sources.objects import ObjectTable

SPLIT, CODE, RAW, PREDICTED = "split", "label_code", "raw_prediction", "predicted"
TRAIN, TEST = "train", "test"
# Fixed value: most training rows of one task, or so. Each is an object of some hundred bytes that every pass reads again.
ROWS_PER_TASK = 500_000


@dataclass(frozen=True)
class TreeSettings:
    """Boosting settings, all explicit."""

    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    bins: int = 32
    seed: int = 0
    checkpoint_every: int = 10
    # Spread the training rows over at least this many partitions, and over one for every
    # ``ROWS_PER_TASK`` rows of the source, before the many passes over them; 0 takes them as scanned.
    least_partitions: int = 0


@dataclass(frozen=True)
class ClassTask:
    """A class label to learn from named features. The keys travel along but are never features."""

    keys: Sequence[str]
    features: Sequence[str]
    label: str
    seed: int = 42
    test_share: float = 0.2
    trees: TreeSettings = field(default_factory=TreeSettings)


@dataclass(frozen=True)
class NumberTask:
    """A number to learn from every other number or boolean column."""

    keys: Sequence[str]
    target: str
    seed: int
    test_share: float = 0.25
    trees: TreeSettings = field(default_factory=TreeSettings)


def _trees(settings: TreeSettings, label: str) -> GBTRegressor:
    return GBTRegressor(
        labelCol=label, featuresCol="features", predictionCol=RAW, maxIter=settings.rounds,
        maxDepth=settings.depth, stepSize=settings.step, maxBins=settings.bins, seed=settings.seed,
        checkpointInterval=settings.checkpoint_every,
    )


def _fit(stages: list, rows: DataFrame, settings: TreeSettings, source: DataFrame) -> PipelineModel:
    """Fit on the given rows, spread first when the settings ask for more partitions.

    Fitting looks at its input several times; spread rows are kept so they move only once. The
    rows of ``source``, of which they are a part, are counted before, without reading a column:
    no task's share grows with the input.
    """
    if not settings.least_partitions:
        return Pipeline(stages=stages).fit(rows)
    wanted = max(settings.least_partitions, -(-source.count() // ROWS_PER_TASK))
    kept = rows.repartition(wanted).persist()
    try:
        return Pipeline(stages=stages).fit(kept)
    finally:
        kept.unpersist()


def prepare(df: DataFrame, task: ClassTask) -> DataFrame:
    """Keys, features as double, label, and the split each row belongs to. One narrow pass."""
    kept = reorder(df, list(dict.fromkeys([*task.keys, *task.features, task.label])))
    if isinstance(kept.select(task.label).schema[0].dataType, T.BooleanType):
        kept = kept.withColumn(task.label, F.col(task.label).cast("string"))
    split = keyed_split(kept, task.keys, task.test_share, task.seed, SPLIT)
    return features_to_double(split, task.features)


def train(df: DataFrame, task: ClassTask) -> PipelineModel:
    """Fit on the training rows. The class list is part of the model, so scoring reuses it."""
    ensure_checkpoint_dir(df.sparkSession)
    prepared = labelled(prepare(df, task), task.label)
    labels = label_list(prepared, task.label)
    codes = StringIndexerModel.from_labels(labels, inputCol=task.label, outputCol=CODE, handleInvalid="keep")
    assembler = VectorAssembler(inputCols=list(task.features), outputCol="features")
    stages = [codes, assembler, _trees(task.trees, CODE)]
    rows = prepared.filter(_training()).select(*task.features, task.label)
    return _fit(stages, rows, task.trees, df)


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def _class_name(code: Column, labels: list[str]) -> Column:
    """Name of a code among the model's own classes; NULL outside their range."""
    names = F.array(*[F.lit(v) for v in labels])
    return F.when(code.between(0, len(labels) - 1), F.get(names, code.cast("int")))


def score(model: PipelineModel, df: DataFrame, task: ClassTask, nearest: bool = False) -> DataFrame:
    """Score every row, training and test alike.

    The predicted code is the fitted number cut toward zero; ``nearest`` rounds it and keeps
    it among the known codes instead. A row whose class is unknown keeps a NULL code, and so
    do all rows of a frame without the label column.
    """
    labels = class_labels(model)
    if task.label not in df.columns:
        df = df.withColumn(task.label, F.lit(None).cast("string"))
    rows = model.transform(prepare(df, task))
    code = nearest_code(F.col(RAW), len(labels)) if nearest else truncated(F.col(RAW))
    known = F.when(F.col(CODE) < len(labels), F.col(CODE).cast("int"))
    return rows.select(
        *task.keys, *task.features, SPLIT, task.label, known.alias(CODE), RAW, code.alias(PREDICTED)
    ).withColumn(f"predicted_{task.label}", _class_name(F.col(PREDICTED), labels))


def score_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy per split and over all labelled rows."""
    return accuracy(scored.filter(F.col(CODE).isNotNull()), PREDICTED, CODE, SPLIT)


def prediction_rows(scored: DataFrame, task: ClassTask) -> DataFrame:
    """Keys, features, and the predicted code in last place under the label's name."""
    return scored.select(*task.keys, *task.features, F.col(PREDICTED).alias(task.label))


def save_predictions(scored: DataFrame, task: ClassTask, table: ObjectTable, load: str | None = None) -> Appended:
    """Append predictions to a table of their own, never to the one they were made from."""
    return append(prediction_rows(scored, task), table, load)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- regression with gaps -------------------------------------------------------------


def number_features(df: DataFrame, task: NumberTask) -> list[str]:
    """Number and boolean columns other than target and keys."""
    left_out = {task.target, *task.keys, SPLIT}
    return [name for name in numeric_columns(df) if name not in left_out]


def prepare_numbers(df: DataFrame, task: NumberTask) -> tuple[DataFrame, list[str]]:
    """Rows with a known target, split, with features that hold a value in some training row."""
    names = number_features(df, task)
    kept = reorder(labelled(df, task.target), list(dict.fromkeys([*task.keys, *names, task.target])))
    split = features_to_double(keyed_split(kept, task.keys, task.test_share, task.seed, SPLIT), names)
    means = fit_means(split, names, _training())
    usable = [name for name in names if means[name] is not None]
    return split.drop(*[name for name in names if means[name] is None]), usable


def _training() -> Column:
    return F.col(SPLIT) == TRAIN


def train_numbers(df: DataFrame, task: NumberTask) -> tuple[PipelineModel, DataFrame]:
    """Fit means and trees on the training rows; returns the model and the prepared rows."""
    ensure_checkpoint_dir(df.sparkSession)
    prepared, names = prepare_numbers(df, task)
    filled = [f"{name}__filled" for name in names]
    imputer = Imputer(strategy="mean", inputCols=names, outputCols=filled)
    stages = [imputer, VectorAssembler(inputCols=filled, outputCol="features"), _trees(task.trees, task.target)]
    target = F.col(task.target).cast(T.DoubleType())
    prepared = prepared.withColumn(task.target, target)
    rows = prepared.filter(_training()).select(*names, task.target)
    return _fit(stages, rows, task.trees, df), prepared


def score_numbers(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """Prepared rows with the fitted number beside them."""
    added = [c for stage in model.stages if hasattr(stage, "getOutputCols") for c in stage.getOutputCols()]
    return model.transform(prepared).drop("features", *added)


def number_errors(scored: DataFrame, task: NumberTask) -> DataFrame:
    """Mean absolute error per split and over all rows."""
    return mean_absolute_error(scored, RAW, task.target, SPLIT)
