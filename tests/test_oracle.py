"""Every registered query with a SQL twin agrees with DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import check, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    problem, _rows = check(entry.queries()[key](spark, SF), con, ORACLES[key])
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracles_are_registered_queries():
    assert set(ORACLES) <= set(entry.queries())
