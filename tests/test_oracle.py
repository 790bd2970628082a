"""Every registered query against its SQL on the smallest tables."""

import pytest

from lakeledger.checks import comparison
from lakeledger.checks.oracle import oracle_sql
from lakeledger.checks.queries import QUERIES

DIRECTORY = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def db():
    return comparison.database(DIRECTORY)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DIRECTORY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "MapInPandas"):
        assert operator not in plan
    count, problem = comparison.difference(df, db, SQL[name])
    assert problem == ""
    assert count > 0


def test_entry_runs_the_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.entry(spark).columns) == {"week", "area", "med", "q25", "q75"}
    assert QUERIES.keys() <= entry.queries().keys()
    assert SQL.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()
