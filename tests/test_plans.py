"""Every named query against its SQL twin on the smallest tables, and plan shapes."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from procspark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.SQL) <= set(entry.oracle_sql())



def _window_inputs(plan):
    """The exchange below each window of a plan text."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if " Window [" in line:
            yield next((x for x in lines[i:] if "Exchange" in x), "")


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql_with_a_distributed_plan(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "strategy=broadcast" not in df._jdf.queryExecution().analyzed().toString()
    assert not any("SinglePartition" in x for x in _window_inputs(plan))
    text, ok = check.compare(spark, con, SF, name, lambda *_: df, plans.SQL[name])
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_id", "split", "labels", "prompt"] and df.count() > 0
