"""Every registered query against its SQL twin at the smallest scale, and a look at its plan."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
# Queries of the optional package may run Python code over whole partitions.
FORBIDDEN_HERE = ["MapInPandas", "MapInArrow"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def rows_sent_to_one_task(plan):
    """Inputs of single-partition exchanges that are not aggregates; page and partition tables are bounded."""
    lines = plan.split("\n")
    inputs = [b for a, b in zip(lines, lines[1:]) if "Exchange SinglePartition" in a]
    return [i for i in inputs if "Aggregate" not in i and "_page#" not in i]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().toString()
    words = FORBIDDEN if name in entry.LLM_QUERIES else FORBIDDEN + FORBIDDEN_HERE
    assert not [word for word in words if word in plan]
    assert not rows_sent_to_one_task(df._jdf.queryExecution().executedPlan().toString())
    if name in ORACLES:
        result = compare(df, con, ORACLES[name])
        assert result.startswith("ok"), result
    else:
        assert df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "customer_segment" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
