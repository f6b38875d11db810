"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from annolake.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert compare(name, spark, con, SF, QUERIES, ORACLES) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
