"""Every registered query against its SQL, and the shape of its plan."""

import os

import pytest

import __spark_entry__ as registry
from tests.compare import compare, connect

SF_DIR = os.environ.get("CLAIMSIFT_SF_DIR", "/root/testdata/sf0.01")
ORACLES = registry.oracle_sql()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    plans = []

    def run(session, directory):
        df = registry.queries()[name](session, directory)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    outcome = compare(spark, duck, name, run, ORACLES[name], SF_DIR)
    assert outcome is None or outcome.startswith("only rounding"), outcome
    assert not [word for word in FORBIDDEN if word in plans[0]]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(registry.queries())


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert {r["label"] for r in rows} == {"de", "en", "es", "fr"}
