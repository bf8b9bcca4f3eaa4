"""Every registered query against its checking SQL."""

import compare
import pytest

import __spark_entry__ as entry_points
from brickwork.catalog.base import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare.difference(df, con, ORACLE[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 65_535
