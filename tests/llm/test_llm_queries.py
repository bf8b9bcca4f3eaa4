"""Registered queries of the subpackage against their SQL."""

import compare
import pytest

from brickwork.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare.difference(df, con, queries.ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op2_decontamination", "op4_redirect_equivalence", "op8_host_rules"])
def test_native(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
