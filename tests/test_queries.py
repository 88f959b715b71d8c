"""Every registered query against its SQL in DuckDB."""

import os

import pytest

import __spark_entry__
import compare
from driftwatch.plans import oracle, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.ORACLE)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["repository", "name", "version", "feature", "zone", "kind"]


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, con, name):
    found = compare.spark_rows(__spark_entry__.queries()[name](spark, SF_DIR))
    assert found == compare.duckdb_rows(con, __spark_entry__.oracle_sql()[name])
