"""Every registered query runs; those with SQL give the same rows."""

import pytest

from checks.compare import database, difference
from checks.oracles import oracles
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SQL = oracles()
ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
