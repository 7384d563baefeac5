"""Plans of the registered queries: no cross joins, no Python in the hot path."""

import ast
from pathlib import Path

import pytest

from conftest import ROOT
from tallymill.operators.runs import last_phase
from tallymill.operators.wordcount import count_windows
from tallymill.plans.bindings import QUERIES

STREAMED = [k for k in QUERIES if "stream" in k or k in ("grep_restart", "als_factors")]
BATCH = [k for k in QUERIES if k not in STREAMED]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_plan(spark, small, key):
    plan = plan_of(QUERIES[key](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key != "wordcount_explicit_combine":
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_word_count_reads_one_column(spark, small):
    plan = plan_of(QUERIES["wordcount"](spark, small))
    assert "ReadSchema: struct<text:string>" in plan


def test_per_suite_limit_is_applied_before_the_shuffle(spark, small):
    plan = plan_of(QUERIES["latest_suite_runs_per_suite"](spark, small))
    assert plan.count("WindowGroupLimit") == 2


def test_latest_runs_keep_only_n_rows_per_task(spark, small):
    assert "TakeOrderedAndProject(limit=15" in plan_of(QUERIES["latest_suite_runs"](spark, small))


def test_no_forced_broadcast_or_local_checkpoint():
    """Spark picks broadcasts by measured size; lineage is cut in shared storage."""
    for file in Path(ROOT).parent.joinpath("tallymill").rglob("*.py"):
        names = {n.attr for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & {"broadcast", "localCheckpoint", "crossJoin", "toPandas"}, file


def test_windows_of_a_frequent_word_are_dealt_out(spark):
    """An exchange stands between the cut into blocks and the windows' rows."""
    plan = plan_of(count_windows(spark.range(10).selectExpr("'a' as k"), "k", 1))
    upper, rest = plan.split("REPARTITION_BY_COL", 1)
    assert upper.count("Generate explode") == 1 and rest.count("Generate explode") == 1


def test_last_phase_needs_no_sort(spark):
    df = spark.range(10).selectExpr("id as run", "'p' as phase", "id as start", "1.0d as duration", "id as seq")
    assert "Sort" not in plan_of(last_phase(df, "run", "phase", "start", "duration", "seq"))
