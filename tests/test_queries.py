"""Every query against its SQL, or for its rows where there is none."""

import pytest

from larkspur.plans import registry
from tests.oracle import assert_same, connect

SQL, QUERIES = registry.oracle_sql(), registry.queries()
SLOW = ("simulate_suite", "benchmark_grid", "audit_full", "tune_nested", "perm_gap_refit", "guard_missforest")  # run by the tests of their operators


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - set(SLOW)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1
