"""Every registered query against its SQL, and what the plans must not contain."""

import os

import pytest

import __spark_entry__ as entry
from adlumen.plans import queries
from tests.compare import differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The text operators have tests of their own, and need not be there.
QUERIES = queries.queries()
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), SQL[name], FOLDER) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plan_stays_in_the_engine(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert word not in plan
