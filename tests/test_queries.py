"""Every query with SQL against DuckDB, and the rest for running."""

from __future__ import annotations

import oracle
import pytest

from corpusloom import plans

SMALL = str(oracle.TESTDATA / "sf0.001")
QUERIES, SQL = plans.all_queries(), plans.all_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SMALL), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
