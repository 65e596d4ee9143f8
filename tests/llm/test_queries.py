"""The registered queries on the smallest tables, next to their SQL where there is one."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tablewright.llm.queries import ORACLES, QUERIES
from tools.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
ROWS = {1: 200, 2: 200, 3: 200, 6: 200, 8: 200, 9: 25, 10: 200}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_whole_table(spark, name):
    rows = QUERIES[name](spark, FOLDER).count()
    number = int(name[2:].split("_")[0])
    assert rows >= 50 if number == 4 else rows >= ROWS.get(number, 200)


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "repeated passages", "best-fit packing"]
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        assert sum(n for _, n in own) <= 2048
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
