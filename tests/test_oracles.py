"""Every query with SQL gives the same result on DuckDB; the others return rows."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

QUERIES = entry.queries()
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    state, note, _ = compare(spark, con, small, name, QUERIES[name], SQLS.get(name))
    assert state in ("OK", "ROWS"), note


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(QUERIES)
