import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.config import Config
from harborline.functions.text import strip
from harborline.operators.clean import (
    capitalise, clean_accounts, clean_nps, clean_tickets, clean_usage,
)

AS_OF = dt.date(2026, 6, 9)


def test_account_window_is_inclusive(spark):
    days = [-31, -30, 0, 90, 91, None]
    rows = [
        (i, " Acme ", "\tPro", "x", "y", "z", None if d is None else str(AS_OF + dt.timedelta(d)))
        for i, d in enumerate(days)
    ]
    df = spark.createDataFrame(
        rows, "account_id int, account_name string, plan_tier string, industry string, "
        "csm_name string, region string, contract_end_date string")
    got = clean_accounts(df).orderBy("account_id").collect()
    assert [r.days_to_renewal for r in got] == days
    assert [r.in_renewal_window for r in got] == [False, True, True, True, False, False]
    assert got[0].account_name == "Acme" and got[0].plan_tier == "Pro"


def test_bad_date_raises(spark):
    df = spark.createDataFrame([("a", "a", "a", "a", "a", "soon")],
                               "account_name string, plan_tier string, industry string, csm_name string, region string, contract_end_date string")
    with pytest.raises(Exception):
        clean_accounts(df).collect()


def test_trim_and_capitalise(spark):
    df = spark.createDataFrame([("\x1c  in PROGRESS \n",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(strip(F.col("s")), capitalise(strip(F.col("s")))).collect()]
    assert got == [("in PROGRESS", "In progress"), ("", ""), (None, None)]


def test_tickets(spark):
    rows = [("2026-03-11", " p1 ", " open", 0.0), ("2026-03-10 10:00:00", "P2", "ESCALATED", 3.0),
            (None, "p3", "resolved", 2.0), ("2026-01-01", "p4", "resolved", float("nan"))]
    df = spark.createDataFrame(rows, "created_date string, priority string, status string, resolution_time_hours double")
    got = clean_tickets(df).collect()
    assert [r.priority for r in got] == ["P1", "P2", "P3", "P4"]
    assert [r.status for r in got] == ["Open", "Escalated", "Resolved", "Resolved"]
    assert [r.is_unresolved for r in got] == [True, True, False, True]


def test_usage_numbers_and_missing_version(spark):
    df = spark.createDataFrame([(1, "2026-01", "5", "n/a", "NaN", None)],
                               "account_id int, month string, api_calls string, content_entries_created string, active_users string, workflows_triggered string")
    row = clean_usage(df).first()
    assert (row.api_calls, row.content_entries_created, row.active_users) == (5.0, None, None)
    assert row.sdk_version == "unknown" and row.month_dt == dt.date(2026, 1, 1)


def test_nps_bands_and_language(spark):
    cases = [
        (0, None, "Detractor", False), (6, " ok ", "Detractor", False), (7, "best pourquoi", "Passive", False),
        (8, "产品很好", "Passive", True), (9, "ÉCLAT", "Promoter", True), (10, "Mais oui", "Promoter", True),
        (11, "EL SOPORTE", None, True), (-1, "it's l'interface", None, True), (5, "test_est", "Detractor", False),
        (5, "est-ce", "Detractor", True),
    ]
    df = spark.createDataFrame([(i, s, c) for i, (s, c, _, _) in enumerate(cases)], "i int, score int, verbatim_comment string")
    got = clean_nps(df).orderBy("i").collect()
    assert [r.nps_category for r in got] == [c[2] for c in cases]
    assert [r.is_non_english for r in got] == [c[3] for c in cases]
    assert got[0].verbatim_comment == "" and got[1].verbatim_comment == "ok"


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        Config(signals=(("usage_decline", 0.5, "x"),))
