from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm.exact_dedup import Fingerprint, drop_exact, exact_groups, fingerprints

SCHEMA = "doc_id long, text string, kept string, size int"  # the last two clash with result columns
ROWS = [
    (5, "a b  c", None, 1), (3, "abc", "x", None), (9, "a\tb\nc ", "x", 2), (1, None, None, None), (2, "", "x", 1), (4, " \n", "y", 1),
    (6, "abd", "x", 1), (7, "x" * 5000 + " y", None, None), (8, "x" * 5000 + "\ny ", "z", 3), (10, "é" * 300, "z", 3), (11, "é " * 300, "z", 3),
    (12, "a b", "z", 3), (13, "ab", "z", 3), (14, "y" + "x" * 5000, "z", 3),
]


def by_hand(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc))
    return sorted(
        (doc, min(own)[1], len(own), doc == min(own)[1], hashlib.sha256(bare.encode()).hexdigest())
        for bare, own in groups.items() for _, doc in own)


@pytest.mark.parametrize("how", [Fingerprint(), Fingerprint(chunk=64), Fingerprint(primes=(2, 2), bases=(1, 1), chunk=1 << 12)])
def test_groups_are_those_of_equal_texts(spark, how):
    """The last fingerprint is so weak that unequal texts collide and are told apart by comparing."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(tuple(r) for r in exact_groups(docs, how).collect()) == by_hand(ROWS)


def test_chunks_combine_to_the_hash_of_the_whole(spark):
    docs = spark.createDataFrame([(0, 1, b"word " * 1000)], "row long, doc_id long, text binary")
    whole, parts = (fingerprints(docs, Fingerprint(chunk=c)).select("size", "h1", "h2").first() for c in (1 << 13, 128))
    assert whole == parts and whole["size"] == 4000
    how = Fingerprint(chunk=16)
    left, right = b"abcdefgh", b"ijkl"
    assert [(a + b) % p for a, b, p in zip(how.of(left, len(right)), how.of(right), how.primes)] == how.of(left + right)


def test_empty_table_and_missing_ids(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a", None, None), (4, "a", None, None)], SCHEMA)
    assert sorted(map(tuple, exact_groups(docs).select("doc_id", "keep_id", "kept").collect()), key=repr) == [(4, 4, True), (None, 4, False)]


def test_stage_keeps_columns_and_drops_repeated_rows(spark):
    docs = spark.createDataFrame([*ROWS, ROWS[0]], SCHEMA)
    kept = drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, *_ in by_hand(ROWS)})
    assert drop_exact(docs.filter(F.lit(False))).count() == 0


def test_rows_are_told_apart_by_more_than_their_id(spark):
    """Texts under no id or one id are texts of their own; one row of each text stays."""
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "d"), (None, "a "), (2, "d"), (1, "c")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _row int, row int, _id int")
    for how in (Fingerprint(), Fingerprint(primes=(2, 2), bases=(1, 1))):
        kept = drop_exact(docs, how)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, "a "), (None, "b"), (1, "c"), (1, "d")], key=repr)
    groups = sorted(((r.doc_id, r.keep_id, r.group_size) for r in exact_groups(docs).collect()), key=repr)
    assert groups == sorted([(None, None, 2), (None, None, 1), (1, 1, 2), (1, 1, 2), (None, None, 2), (1, 1, 2), (2, 1, 2)], key=repr)
