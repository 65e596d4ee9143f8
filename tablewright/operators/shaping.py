"""Column shaping: names, order, identifiers, types. All narrow: no operator here shuffles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.keyed import check_hash_keys, key_digest
from tablewright.functions.scalars import blank, null_double, to_double


def lower_names(df: DataFrame) -> DataFrame:
    """Every column name in lower case. Raises when two names would become one."""
    lowered = [name.lower() for name in df.columns]
    clashes = [name for name, times in Counter(lowered).items() if times > 1]
    if clashes:
        raise ValueError(f"names differ only in case: {clashes}")
    return df.toDF(*lowered)


def reorder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns in the listed order; the result carries the case asked for."""
    return df.select(*[F.col(f"`{name}`").alias(name) for name in columns])


def with_first(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Put a new column in front."""
    if not name:
        raise ValueError("the new column needs a name")
    return df.select(value.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def with_surrogate_id(df: DataFrame, name: str) -> DataFrame:
    """Unique 64-bit id in front. Not dense, and it follows the partitioning of this run."""
    return with_first(df, name, F.monotonically_increasing_id())


def with_row_key(df: DataFrame, name: str, keys: Sequence[str], seed: int | str = 0) -> DataFrame:
    """Stable id in front: the same row gets the same id whatever the partitioning."""
    check_hash_keys(df, keys)
    return with_first(df, name, key_digest(keys, seed))


def with_null_id(df: DataFrame, object_name: str) -> DataFrame:
    """``{object}_id`` as a typed NULL in front, for stores that assign ids themselves."""
    return with_first(df, f"{object_name}_id", null_double())


def without(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All but the listed columns."""
    return df.drop(*columns)


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; raises for a name that is not there."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(names))


def blanked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace whole columns by empty text."""
    return df.withColumns({name: blank() for name in columns})


def incremented(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add one to each listed column."""
    return df.withColumns({name: F.col(name) + F.lit(1) for name in columns})


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of number and boolean columns, in schema order."""
    kept = (T.NumericType, T.BooleanType)
    return [field.name for field in df.schema.fields if isinstance(field.dataType, kept)]


def only_numeric(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Number and boolean columns, less those in ``drop``."""
    return reorder(df, [name for name in numeric_columns(df) if name not in set(drop)])


def features_to_double(df: DataFrame, features: Sequence[str], strict: bool = True) -> DataFrame:
    """Cast the features to double in place, all other columns untouched."""
    kinds = {field.name: field.dataType for field in df.schema.fields}
    return df.withColumns({name: to_double(F.col(name), kinds[name], strict) for name in features})
