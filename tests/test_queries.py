"""Every registered query against its oracle, and the plans of all of them."""

from __future__ import annotations

import inspect

import pytest

import __spark_entry__ as entry
from tablewright.plans.queries import ORACLES, QUERIES
from tests.conftest import plan
from tools.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
# Queries that fit models or time things; their plans are the library's, checked elsewhere.
HEAVY = {name for name in QUERIES if name.startswith(("gbt_", "roundtrip_", "volume_run"))}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql().get(name)) is None


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() == 6


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_plans_stay_distributed_and_in_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for word in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert word not in text
    if "SinglePartition" in text:
        # One task may only merge the partial results of a table-wide aggregate, or take a few rows.
        below = text[text.index("SinglePartition"):].split("\n")[1]
        assert "partial_" in below or "LocalLimit" in below


def test_queries_take_a_session_and_a_folder():
    for name, run in entry.queries().items():
        assert len(inspect.signature(run).parameters) == 2, name
