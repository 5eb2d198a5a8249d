"""Every registered query that SQL can state, against DuckDB on the smallest tables."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLE[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_twin_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
