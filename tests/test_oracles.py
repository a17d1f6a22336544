"""Every registered query against its SQL in DuckDB, on whole tables, and its physical plan.

Broadcasting by size is switched off, so the plans and the results are those of large tables.
"""

import re

import pytest
from check_oracles import compare, database

from careflow.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
UNWANTED = [
    "CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
]
# a window above a single-partition exchange
GLOBAL_WINDOW = re.compile(r"Window \[[^\n]*\n(?:[^\n]*(?:Sort|Project|Filter) [^\n]*\n)*[^\n]*Exchange SinglePartition")
# it may only order block totals (at most one row per 2^40 values) or 12 calendar months
BOUNDED_GLOBAL_WINDOW = {
    "p14_income_inequality_index", "p14_income_inequality_dense_rank", "a18_pollen_seasonality_acceleration",
}


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def no_broadcast_by_size(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in UNWANTED if op in plan]
    assert bool(GLOBAL_WINDOW.search(plan)) == (name in BOUNDED_GLOBAL_WINDOW)
    assert compare(df, con, ORACLES[name]) is None
