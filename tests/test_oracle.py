"""Every registered query against its SQL on the test tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0
