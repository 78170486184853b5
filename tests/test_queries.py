"""Every registered query against its SQL oracle, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry_point
from tests.compare import connect, differences
from harborline.plans.scoring import score_accounts, with_rank
from workload import queries as workload_queries
from workload.fixtures import Inputs
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))
PYTHON_STAGE = {
    "reconcile_fuzzy", "account_scores_reconciled", "enrich_notes", "enrich_notes_fallback",
    "translate_comments", "notes_overview", "explanation_fallback", "silent_churn", "portfolio_fallback",
    "enrich_notes_stored", "translate_comments_stored", "silent_churn_stored",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(inputs, con, name):
    assert differences(QUERIES[name](inputs), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(inputs, name):
    assert len(QUERIES[name](inputs).collect()) > 0


def test_entry_registers_every_query(spark):
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 150
    assert [r.risk_score for r in rows] == sorted((r.risk_score for r in rows), reverse=True)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_STAGE))
def test_plan_stays_in_the_jvm_without_cross_joins(inputs, name):
    plan = QUERIES[name](inputs)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan, bad


def test_scoring_plan_shuffles_each_source_once(spark, inputs):
    """Without size-based broadcasts, accounts, tickets, survey and notes are each
    shuffled once, the facts as partial aggregates, and the joins add nothing."""
    tables = []
    for name in ("accounts", "usage", "tickets", "nps", "known_notes"):
        df = getattr(inputs, name)
        tables.append(spark.createDataFrame(df.limit(5).collect(), df.schema))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = score_accounts(*tables, window_only=False)
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = re.findall(r"SortMergeJoin \[account_id#(\d+)L\], \[account_id#(\d+)L\], LeftOuter", plan)
    assert len(joins) == 4 and len({left for left, _ in joins}) == 1
    notes, nps, tickets, _usage = (right for _, right in joins)
    for key in (joins[0][0], nps, tickets):
        assert plan.count(f"Exchange hashpartitioning(account_id#{key}L, ") == 1
    assert plan.count("Exchange hashpartitioning(matched_account_id#") == 1
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if f"Exchange hashpartitioning(account_id#{tickets}L" in line or "hashpartitioning(matched_account_id#" in line:
            assert "partial_" in lines[i + 1]


def test_account_scores_ranks_narrow_rows(spark, monkeypatch):
    """The ranking writes the rows it gets: the breakdown and other columns that are not returned stay out of it."""
    seen = []
    monkeypatch.setattr(workload_queries, "with_rank", lambda rows: seen.append(rows.columns) or with_rank(rows))
    result = workload_queries.run("account_scores", spark, SF)
    assert [[*seen[0], "rank"]] == [result.columns] and "score_breakdown" not in seen[0]
