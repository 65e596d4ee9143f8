from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm.fixity import audit, placed, record

SCHEMA = "file long, offset long, length long, hash string"


def test_differences_are_located(spark):
    random.seed(1)
    rows = [(f, o * 1_000, 10, f"h{f}-{o}") for f in range(40) for o in range(90)]
    changed = {(3, 7_000), (3, 8_000), (39, 89_000)}
    lost = {(0, 0), (20, 50_000)}
    other = [(f, o, n, h + "x" if (f, o) in changed else h) for f, o, n, h in rows if (f, o) not in lost]
    other += [(41, 5, 3, "new"), (20, 50_500, 3, "new")]
    random.shuffle(other)
    one, two = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA).repartition(3)
    found = {(r.file, r.offset): r.status for r in audit(one, two).collect()}
    assert found == {**{c: "changed" for c in changed}, **{x: "missing" for x in lost}, (41, 5): "extra", (20, 50_500): "extra"}
    assert audit(one, one).count() == 0


def test_lengths_repeated_places_and_empty_replicas(spark):
    one = spark.createDataFrame([(0, 0, 5, "a"), (0, 5, 5, "b"), (0, 5, 5, "b"), (1, 0, 2, "c")], SCHEMA)
    two = spark.createDataFrame([(0, 0, 6, "a"), (0, 5, 5, "b"), (1, 0, 2, "c")], SCHEMA)
    found = [(r.file, r.offset, r.status, r.first_hash, r.second_hash) for r in audit(one, two).orderBy("offset").collect()]
    assert found == [(0, 0, "changed", "a", "a"), (0, 5, "changed", "b,b", "b")]
    empty = one.limit(0)
    assert audit(empty, empty).count() == 0
    assert {r.status for r in audit(one, empty).collect()} == {"missing"} and {r.status for r in audit(empty, one).collect()} == {"extra"}


@pytest.mark.parametrize("offset", [1 << 40, -1])
def test_offsets_that_would_reach_into_other_files_are_refused(spark, offset):
    one = spark.createDataFrame([(0, 0, 5, "a")], SCHEMA)
    with pytest.raises(ValueError):
        audit(one, spark.createDataFrame([(0, offset, 5, "a")], SCHEMA))


def test_records_and_their_places(spark):
    pages = spark.createDataFrame([(2, "http://x/", "<p>é"), (1, None, None), (3, "u", "v"), (3, "u", "v")], "page_id long, url string, html string")
    bodies = {r.page_id: bytes(r.r) for r in pages.select("page_id", record().alias("r")).collect()}
    assert bodies[2].endswith(b"Content-Length: 5\r\n\r\n<p>\xc3\xa9\r\n\r\n") and b"Content-Length: 0\r\n\r\n\r\n\r\n" in bodies[1]
    sized = pages.select("page_id", F.octet_length(record()).cast("long").alias("length"))
    rows = [(r.page_id, r.file, r.offset, r.length) for r in placed(sized, "page_id", per_file=2).orderBy("file", "offset").collect()]
    assert [r[:2] for r in rows] == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert rows[1][2] == rows[0][3] and rows[3][2] == rows[2][3] and rows[0][2] == rows[2][2] == 0
    assert placed(sized.limit(0), "page_id").count() == 0
