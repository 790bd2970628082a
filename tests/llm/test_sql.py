"""Queries that SQL can express against their SQL, on the smallest tables."""

import pytest

from lakeledger.checks import comparison
from lakeledger.llm.oracle import SQL
from lakeledger.llm.queries import QUERIES

DIRECTORY = "/root/testdata/sf0.001"
#: Operators in a free style, whose tasks may use Arrow.
FREE = ("op13_window_dedup",)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DIRECTORY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"):
        assert operator not in plan or (name in FREE and operator == "Arrow")
    count, problem = comparison.difference(df, comparison.database(DIRECTORY), SQL[name])
    assert problem == "" and count > 0
