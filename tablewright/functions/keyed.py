"""Keyed hashing: reproducible draws that do not depend on partitioning.

``rand`` and ``randomSplit`` give other values when the number of partitions changes
or a task is retried. A hash of the row's own key does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text forms of these types are the same in every engine; floating point is not.
_HASHABLE = (T.IntegralType, T.StringType, T.BooleanType, T.DateType)


def check_hash_keys(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key is missing or its text form is not portable."""
    if not keys:
        raise ValueError("at least one key column is needed")
    for name in keys:
        kind = df.select(name).schema[0].dataType
        if not isinstance(kind, _HASHABLE):
            raise TypeError(f"key {name!r} is {kind.simpleString()}; use integers, text, booleans or dates")


def key_digest(keys: Sequence[str], seed: int | str) -> Column:
    """32 hex digits of ``md5(key1:key2:...:seed)``.

    Backslashes and colons inside a key are preceded by a backslash and a NULL key is ``\\N``,
    so different keys never have the same text.
    """
    parts: list[Column] = []
    for name in keys:
        text = F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
        parts += [F.coalesce(text, F.lit("\\N")), F.lit(":")]
    return F.md5(F.concat(*parts, F.lit(str(seed))))


def digest_number(digest: Column, start: int, digits: int) -> Column:
    """Hex digits ``start .. start+digits-1`` (1-based, at most 15) as a long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


# Fixed value: the largest prime below 2^30, the size of a word.
WORD_PRIME = 1_073_741_789
ROUNDS, WORDS = 5, 3


def round_constants(seed: int | str) -> list[int]:
    """One number below 2^28 for each round, and one for the high part of a row id."""
    return [int(hashlib.md5(f"{seed}:{n}".encode()).hexdigest()[:7], 16) for n in range(ROUNDS + 1)]


def with_words(df: DataFrame, row_id: str, seed: int | str, names: Sequence[str]) -> DataFrame:
    """Add three words, numbers below the prime, that follow from a row id of 0 or more and a seed.

    Each round adds a constant and takes the third power modulo the prime, which maps the
    words one to one; the last three states are the words. Whole numbers only, so another
    engine gets the same, and much cheaper than reading numbers out of a hash's hex digits.
    """
    *added, high = round_constants(seed)
    prime, state = F.lit(WORD_PRIME).cast("long"), "__state"
    key = F.col(row_id).cast("long")
    out = df.withColumn(state, (key % prime + F.call_function("div", key, prime) % prime * high) % prime)
    for n, constant in enumerate(added):
        out = out.withColumn(state, (F.col(state) + constant) % prime)  # a column of its own: its code occurs once
        out = out.withColumn(state, F.col(state) * F.col(state) % prime * F.col(state) % prime)
        if n >= ROUNDS - WORDS:
            out = out.withColumn(names[n - ROUNDS + WORDS], F.col(state))
    return out.drop(state)


def uniform_int(words: list[Column], draw: int, low: int, high: int) -> Column:
    """Whole number in ``[low, high]``: draw number ``draw`` of a row with these words.

    The words are the coefficients of a quadratic, evaluated at the draw's number, so three
    words serve all draws of a row, and all of them stay in one compiled function.
    """
    if high < low:
        raise ValueError("high must not be below low")
    value = words[-1]
    for word in words[-2::-1]:
        value = value * F.lit(draw).cast("long") + word
    return F.lit(low).cast("long") + value % F.lit(high - low + 1).cast("long")


# Draws that one digest of 32 hex digits yields, eight digits each.
SLOTS = 4


def digest_int(digest: Column, slot: int, low: int, high: int) -> Column:
    """Whole number in ``[low, high]`` from one of a digest's four slots (0 to 3): a draw of its own."""
    if high < low:
        raise ValueError("high must not be below low")
    drawn = digest_number(digest, 8 * slot + 1, 8)
    return F.lit(low).cast("long") + drawn % F.lit(high - low + 1).cast("long")


def share_threshold(share: float) -> str:
    """Hex bound ``t`` such that ``substr(digest, 1, 8) < t`` holds for ``share`` of keys."""
    if not 0.0 < share < 1.0:
        raise ValueError("share must lie strictly between 0 and 1")
    return f"{int(share * 16**8):08x}"
