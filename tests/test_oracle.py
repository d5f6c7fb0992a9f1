"""Every query against its SQL on the test tables."""

import os

import pytest
from compare import differences, duck

import __spark_entry__ as contract

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SQL = contract.oracle.oracle_sql()
QUERIES = contract.QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"embed_texts", "mlp_predict", "network_history"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() > 0
