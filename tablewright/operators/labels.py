"""Class labels and their codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.sizes import broadcast_if_small
from tablewright.operators.tables import dense_ids

_NAME, _CODE = "__label", "__code"
MODEL_CLASSES = 10_000


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """One row per known class. Combined on the map side, so a frequent class costs nothing extra."""
    return df.select(label).filter(F.col(label).isNotNull()).distinct()


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """A written table of the classes: ``label`` (text) and ``code`` from 0, in order of value.

    Numbers are ordered as numbers. The classes never pass through the driver, so their
    number is not bounded.
    """
    numbered = dense_ids(distinct_labels(df, label).select(F.col(label).alias("value")), ["value"], "code", 0)
    return numbered.select(F.col("value").cast("string").alias("label"), F.col("code").cast("int").alias("code"))


def label_list(df: DataFrame, label: str) -> list[str]:
    """The classes as text, in order of value: for a model, which holds its own classes.

    A model of more than ``MODEL_CLASSES`` is refused: its class list is part of its plan.
    """
    known = distinct_labels(df, label).withColumn("text", F.col(label).cast("string")).limit(MODEL_CLASSES + 1).collect()
    if len(known) > MODEL_CLASSES:
        raise ValueError(f"{label!r} has more than {MODEL_CLASSES} classes")
    return [text for _, text in sorted((row[0], row[1]) for row in known)]


def with_codes(df: DataFrame, label: str, codes: DataFrame, column: str) -> DataFrame:
    """Add the class code of ``label``; NULL for a missing or unknown class."""
    known = broadcast_if_small(codes.select(F.col("label").alias(_NAME), F.col("code").alias(column)))
    return df.join(known, F.col(label).cast("string") == F.col(_NAME), "left").drop(_NAME)


def decoded(df: DataFrame, code: str, codes: DataFrame, column: str) -> DataFrame:
    """Add the class name of a code; NULL outside the known range."""
    known = broadcast_if_small(codes.select(F.col("code").alias(_CODE), F.col("label").alias(column)))
    return df.join(known, F.col(code) == F.col(_CODE), "left").drop(_CODE)
