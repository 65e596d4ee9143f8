"""Scalar rules used by change feeds, casts and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def external_id(index: Column) -> Column:
    """``ext_7`` for row index 7."""
    return F.concat(F.lit("ext_"), index.cast("string"))


def id_number(external: Column) -> Column:
    """Text between the first and second underscore; NULL when there is none."""
    return F.get(F.split(external, "_"), F.lit(1))


def batch_suffix(batch: Column) -> Column:
    """At least three digits, zero-padded; longer numbers keep all their digits."""
    return F.format_string("%03d", batch)


def blank() -> Column:
    """Empty text, which CSV readers and id assignment tell apart from a number."""
    return F.lit("")


def to_double(column: Column, kind: T.DataType, strict: bool = True) -> Column:
    """One feature as double. Text may spell a boolean or a number.

    ``strict`` raises on other text (as an ANSI cast does); otherwise it becomes NULL.
    """
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    if not isinstance(kind, T.StringType):
        return column.cast("double")
    text = F.lower(F.trim(column))
    number = column.cast("double") if strict else column.try_cast("double")
    return F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(number)


def truncated(prediction: Column) -> Column:
    """Drop the fraction, toward zero."""
    return prediction.cast("int")


def nearest_code(prediction: Column, classes: int) -> Column:
    """Nearest class code, kept inside ``0 .. classes-1``."""
    rounded = F.floor(prediction + F.lit(0.5))
    return F.greatest(F.lit(0), F.least(F.lit(classes - 1), rounded)).cast("int")


def null_double() -> Column:
    """A typed NULL, so that a store can fill the column itself."""
    return F.lit(None).cast("double")
