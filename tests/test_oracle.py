"""Every registered query with reference SQL gives the SQL's result."""

from __future__ import annotations

import pytest
from check import compare, oracle
from conftest import SF

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    con = oracle(SF)
    yield con
    con.close()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "loss", "l_near", "l_distant"]
    assert df.count() == 10


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], SQL[name], SF) is None
