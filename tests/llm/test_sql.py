"""Queries with SQL give the same rows."""

import pytest

from checks.compare import database, difference
from inkwell.llm.queries import ORACLES, QUERIES


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small), database(small), ORACLES[name]) is None
