"""Every query with SQL gives the rows of that SQL; every other one runs."""

import pytest
from oracle import compare, connect

from textloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], ORACLE_SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
