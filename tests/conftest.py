from __future__ import annotations

import pytest

from tablewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tablewright-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df) -> str:
    """The physical plan as text, before adaptive changes."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]
