"""Every registered query against its oracle SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_queries import ORACLES
from registered import QUERIES
from check_oracles import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, connection, key):
    problem = compare(spark, connection, SF_DIR, QUERIES[key], ORACLES[key])
    assert problem is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["query_id", "doc_id", "rank"] and df.count() == 400
