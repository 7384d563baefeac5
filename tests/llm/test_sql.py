"""Queries that SQL can express, against that SQL; all queries are registered."""

import pytest

import __spark_entry__ as spark_entry
import oracle
from tallymill.llm.oracles import ORACLES
from tallymill.llm.queries import QUERIES


def test_registered():
    assert len(QUERIES) == 13 and set(QUERIES) | {"pipeline"} <= set(spark_entry.queries())
    assert set(ORACLES) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("key", list(ORACLES))
def test_same_rows(spark, medium, key):
    found = oracle.spark_table(QUERIES[key](spark, medium))
    assert found == oracle.duck_table(oracle.connect(medium), ORACLES[key])


NATIVE = ["op1_quality_rules", "op2_decontamination", "op5_chat_formatting", "op6_line_dedup", "op7_secret_scans"]


@pytest.mark.parametrize("key", NATIVE)
def test_native_plans(spark, small, key):
    plan = QUERIES[key](spark, small)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
