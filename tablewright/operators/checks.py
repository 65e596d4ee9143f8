"""Checks on loads: counts, keys, and content regardless of row order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.sizes import broadcast_if_small
from tablewright.session import written


class CountMismatch(Exception):
    """A table does not hold the rows it should."""

    def __init__(self, expected: int, found: int, what: str = "rows"):
        super().__init__(f"expected {expected} {what}, found {found}")
        self.expected, self.found = expected, found


def require_count(expected: int, found: int, what: str = "rows") -> int:
    if found != expected:
        raise CountMismatch(expected, found, what)
    return found


@dataclass(frozen=True)
class Fingerprint:
    """Row count plus two sums over row hashes; equal for equal bags of rows."""

    rows: int
    folded: int
    total: int


def _gaps(cells: Sequence[Column]) -> list[Column]:
    """Which cells are NULL, as bits of longs: much cheaper per row than a text of digits."""
    bits = [F.when(c.isNull(), F.lit(1 << n % _GAPS).cast("long")).otherwise(F.lit(0).cast("long")) for n, c in enumerate(cells)]
    return [reduce(Column.bitwiseOR, bits[at:at + _GAPS]) for at in range(0, len(bits), _GAPS)]


_GAPS = 62  # cells whose gaps one long holds
_PIECE = 22  # bits of a row hash summed at a time: long sums hold for 2^41 rows


def fingerprint_cells(columns: Sequence[str]) -> list[Column]:
    """The aggregates of a fingerprint, for ``agg`` or for ``observe`` during a write.

    The exclusive-or alone would miss pairs of equal rows, hence the sum beside it. It is
    taken over three pieces of the hash, which is cheaper than one wide decimal.
    """
    cells = [F.col(f"`{c}`") for c in columns]
    row_hash = F.xxhash64(*cells, *_gaps(cells))  # the hash alone skips NULL
    mask = F.lit((1 << _PIECE) - 1)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(row_hash).alias("folded"),
        F.sum(row_hash.bitwiseAND(mask)).alias("low"),
        F.sum(F.shiftright(row_hash, _PIECE).bitwiseAND(mask)).alias("middle"),
        F.sum(F.shiftright(row_hash, 2 * _PIECE)).alias("high"),
    ]


def as_fingerprint(row: dict) -> Fingerprint:
    low, middle, high = (int(row[name] or 0) for name in ("low", "middle", "high"))
    return Fingerprint(int(row["rows"]), int(row["folded"] or 0), low + (middle << _PIECE) + (high << 2 * _PIECE))


def fingerprint(df: DataFrame) -> Fingerprint:
    """One scan, one result row."""
    return as_fingerprint(df.agg(*fingerprint_cells(df.columns)).first().asDict())


def load_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with a missing key, and surplus rows per key, as one row.

    Counting per key first lets the map side merge a frequent key before the shuffle.
    """
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("no_key", no_key)
    surplus = F.when(~F.col("no_key"), F.col("n") - 1).otherwise(F.lit(0))
    known = lambda total: F.coalesce(F.sum(total), F.lit(0)).cast("long")
    return per_key.agg(
        known(F.col("n")).alias("rows"),
        known(F.when(F.col("no_key"), F.col("n")).otherwise(F.lit(0))).alias("null_keys"),
        known(surplus).alias("duplicate_keys"),
    )


def check_schema(df: DataFrame, expected: T.StructType) -> None:
    """Raise when a column is missing, surplus or of another type. Nullability is ignored."""
    found = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in expected.fields}
    wrong = sorted(name for name in found.keys() | wanted.keys() if found.get(name) != wanted.get(name))
    if wrong:
        raise ValueError(f"columns do not match the declared schema: {wrong}")


def check_load(df: DataFrame, keys: Sequence[str], expected: T.StructType | None = None) -> int:
    """Validate a load before it is written; returns its row count."""
    if expected is not None:
        check_schema(df, expected)
    report = load_report(df, keys).first()
    if report.null_keys or report.duplicate_keys:
        raise ValueError(f"{report.null_keys} rows without key, {report.duplicate_keys} rows repeat a key")
    return report.rows


KEYS_PER_WORD = 6  # of a Bloom filter with four bits for a key in one word of 64
FILTER_BYTES = 256 << 20


def _word_and_mask(keys: Sequence[str], words: int) -> tuple[Column, Column]:
    """The word of a key's bits, and the bits: four of 64, by six digits of a second hash each."""
    spot = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(words).cast("long"))
    other = F.xxhash64(*[F.col(k) for k in keys], F.lit(1))
    mask = F.lit(0).cast("long")
    for digit in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(other, 6 * digit).bitwiseAND(F.lit(63)).cast("int")))
    return spot, mask


def known_keys(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``rows`` that ``table`` holds too; a key with a NULL is held by nothing.

    Only the table's key columns are read, and its rows pass a Bloom filter of the keys of
    ``rows`` where they are: the few that may be among them, about one in a hundred of the
    others, are joined. The filter is broadcast once its size is known to be small; one
    beyond ``FILTER_BYTES``, some thirty million keys, is left to a shuffle of the table's keys.
    """
    mine = rows.select(*keys).na.drop().distinct()
    mine = written(mine, "load-keys")
    words = max(1, -(-mine.count() // KEYS_PER_WORD))
    spot, mask = _word_and_mask(keys, words)
    bits = written(mine.select(spot.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits")), "load-filter")
    held = table.select(*keys).na.drop().withColumns({"__spot": spot, "__mask": mask})
    likely = held.join(broadcast_if_small(bits, FILTER_BYTES), F.col("__spot") == F.col("__word"))
    likely = likely.filter(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask")).select(*keys).distinct()
    return likely.join(mine, list(keys), "left_semi")
