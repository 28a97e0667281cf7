"""Every registered query runs, and gives the rows of its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from lexloom import queries
from tests.oracle import SF, connect, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        expected = con.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows_of(got) == rows_of(expected)
    assert len(got)


def test_entry(spark):
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
