"""Exact duplicates by composable polynomial fingerprints.

A text without white space is the byte string b0..bn. Its fingerprint is, for each of two
primes, the value of the polynomial sum(b_i * BASE**(n-1-i)). Chunks of a text are hashed
independently; a chunk's value times BASE**(bytes after it) is its part of the whole, so the
parts of a huge text come from different tasks and meet in one sum. Equal fingerprints only
propose a group: every member's chunks are then compared with those of the row that stays,
and rows that differ are grouped again among themselves until none is left over.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WHITE_SPACE, mapped, numbered, numbered_texts
from tablewright.operators.sizes import broadcast_if_small
from tablewright.session import written

KEY = ["size", "h1", "h2"]


@dataclass(frozen=True)
class Fingerprint:
    """Parameters of the hash: two primes below 2**31, a base for each, and bytes per chunk."""

    primes: tuple[int, int] = (2_147_483_647, 2_147_483_629)
    bases: tuple[int, int] = (1_103_515_245, 1_664_525_001)
    chunk: int = 1 << 16

    def of(self, data: bytes, after: int = 0) -> list[int]:
        """Values of one chunk, shifted by the ``after`` bytes that follow it in its text."""
        found = []
        for prime, base in zip(self.primes, self.bases):
            powers = _powers(prime, base, self.chunk)
            cells = np.frombuffer(data, np.uint8).astype(np.int64)
            value = int(cells @ powers[self.chunk - len(cells):] % prime) if len(cells) else 0
            found.append(value * pow(base, after, prime) % prime)
        return found


_tables: dict[tuple[int, int, int], np.ndarray] = {}


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """base**(n-1) .. base**0 mod prime."""
    if (prime, base, n) not in _tables:
        values, power = np.empty(n, np.int64), 1
        for i in range(n - 1, -1, -1):
            values[i] = power
            power = power * base % prime
        _tables[prime, base, n] = values
    return _tables[prime, base, n]


def fingerprints(texts: DataFrame, how: Fingerprint = Fingerprint()) -> DataFrame:
    """Per row of ``texts`` (row, doc_id, text as bytes): row, doc_id, points (code points of the
    original text), size (bytes without white space), h1, h2 and text_sha256, the hash of the
    text without white space.

    Texts of more bytes than one chunk are cut, their chunks dealt out to all tasks, and the
    shifted values summed per text.
    """
    texts = texts.select("row", "doc_id", F.length(F.col("text").cast("string")).cast("long").alias("points"), "text")
    is_long = F.octet_length("text") > how.chunk

    def short(batches):
        for b in batches:
            for row, doc, points, text in zip(b["row"], b["doc_id"], b["points"], b["text"]):
                data = text.translate(None, WHITE_SPACE)
                yield row, doc, points, len(data), *how.of(data), hashlib.sha256(data).hexdigest()

    def cut(batches):
        for b in batches:
            for row, doc, points, text in zip(b["row"], b["doc_id"], b["points"], b["text"]):
                data = text.translate(None, WHITE_SPACE)
                digest = hashlib.sha256(data).hexdigest()
                for start in range(0, max(len(data), 1), how.chunk):
                    piece = data[start:start + how.chunk]
                    yield row, doc, points, len(data), digest, len(data) - start - len(piece), piece

    def part(batches):
        for b in batches:
            for row, doc, points, size, digest, after, piece in zip(*(b[c] for c in ("row", "doc_id", "points", "size", "text_sha256", "after", "piece"))):
                yield row, doc, points, size, digest, *how.of(piece, after)

    kinds = "row long, doc_id long, points long, size long, h1 long, h2 long, text_sha256 string"
    few = mapped(texts.filter(~is_long), short, kinds)
    chunks = mapped(
        texts.filter(is_long), cut,
        "row long, doc_id long, points long, size long, text_sha256 string, after long, piece binary",
    )
    parts = mapped(
        chunks.repartition("row", "after"), part,
        "row long, doc_id long, points long, size long, text_sha256 string, h1 long, h2 long",
    )
    many = parts.groupBy("row", "doc_id", "points", "size", "text_sha256").agg(
        *((F.sum(h) % p).alias(h) for h, p in zip(("h1", "h2"), how.primes))
    )
    return few.unionByName(many.select(few.columns))


def _differing(texts: DataFrame, pairs: DataFrame, chunk: int) -> DataFrame:
    """Rows of ``pairs`` (row, keep_row) whose texts without white space are not equal.

    Texts meet chunk by chunk in a join on (keep_row, chunk number): no task holds a group, and
    a row that stays for very many is split from its partners by the skew join.
    """

    def cut(batches):
        for b in batches:
            for row, text in zip(b["row"], b["text"]):
                data = text.translate(None, WHITE_SPACE)
                for start in range(0, max(len(data), 1), chunk):
                    yield row, start, data[start:start + chunk]

    keepers = pairs.select("keep_row").distinct()
    wanted = pairs.select("row").union(keepers).distinct()
    pieces = written(
        mapped(texts.select("row", "text").join(broadcast_if_small(wanted), "row", "left_semi"), cut, "row long, start long, piece binary"),
        "dedup-chunks",
    )
    mine = pieces.join(broadcast_if_small(pairs), "row")
    theirs = pieces.join(broadcast_if_small(keepers), pieces.row == keepers.keep_row).select("keep_row", "start", F.col("piece").alias("other"))
    return (
        mine.join(theirs, ["keep_row", "start"], "left")
        .filter(F.col("other").isNull() | (F.col("other") != F.col("piece")))
        .select("row").distinct()
    )


def _groups(texts: DataFrame, how: Fingerprint) -> DataFrame:
    """Per row: row, doc_id, keep_row, keep_id, group_size, text_sha256."""
    pending = written(fingerprints(texts, how), "fingerprints")
    done = None
    while True:
        best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
        groups = pending.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"), best).filter("group_size > 1")
        groups = written(groups.select(*KEY, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "dedup-keepers")
        members = pending.join(broadcast_if_small(groups), KEY, "left").withColumns({
            "keep_id": F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")),
            "keep_row": F.coalesce("keep_row", "row"), "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        })
        members = written(members.select("row", "doc_id", "keep_row", "keep_id", "group_size", "text_sha256", *KEY), "dedup-groups")
        pairs = members.filter("row <> keep_row").select("row", "keep_row")
        wrong = written(_differing(texts, pairs, how.chunk), "dedup-differing")
        if wrong.isEmpty():
            break
        right = members.join(wrong, "row", "left_anti").drop("group_size")
        sizes = right.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"))
        right = right.join(sizes, KEY)
        done = right if done is None else done.unionByName(right)
        pending = written(pending.join(wrong, "row", "left_semi"), "fingerprints")
    return members if done is None else done.unionByName(members)


def exact_groups(docs: DataFrame, how: Fingerprint = Fingerprint()) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and empty texts are equal. The row with the most code points, then the smallest
    doc_id, stays; null ids come last. Every row has its own text: rows that share a doc_id are
    grouped by their texts like all others, and ``kept`` says that the row's doc_id is the
    one that stays. An empty table gives no rows.
    """
    return _groups(numbered_texts(docs), how).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact(docs: DataFrame, how: Fingerprint = Fingerprint()) -> DataFrame:
    """One row of each group of equal texts, with the columns it came with, whatever its doc_id."""
    docs, row, texts = numbered(docs)
    gone = written(_groups(texts, how).filter("row <> keep_row").select(F.col("row").alias(row)), "copies")
    return docs.join(broadcast_if_small(gone), row, "left_anti").drop(row)
