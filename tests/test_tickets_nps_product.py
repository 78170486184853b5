
import pytest
from pyspark.sql import functions as F

from harborline.config import Config
from harborline.operators import nps, product, tickets
from harborline.operators.clean import clean_nps, clean_tickets
from tests.conftest import by_key

T = "ticket_id string, account_id bigint, created_date string, priority string, status string, resolution_time_hours double, subject string, description string"


def ticket_frame(spark, rows):
    return clean_tickets(spark.createDataFrame([(f"t{i}", *r) for i, r in enumerate(rows)], T))


def test_ticket_summary(spark):
    df = ticket_frame(spark, [
        (1, "2026-03-11", "p1", "open", None, "SDK Upgrade Guidance please", "RECURRING and blocking"),
        (1, "2026-03-10", "p1", "Escalated", 4.0, "other", None),
        (1, None, "p2", "resolved", 5.0, None, "blocking"),
        (2, "2026-05-01", "p3", "resolved", 0.0, "x", "y"),
    ])
    got = by_key(tickets.ticket_summary(df))
    r = got[1]
    assert (r.total_tickets, r.recent_tickets, r.older_tickets) == (3, 1, 1)
    assert (r.p1_count, r.p2_count, r.recent_p1_count, r.open_count, r.escalated_count) == (2, 1, 1, 2, 1)
    assert (r.recurring_count, r.blocking_count, r.linked_tickets) == (1, 2, 1)
    assert r.avg_resolution_hours == 4.5 and r.volume_change == 0.0
    assert (r.p1_tickets, r.open_tickets) == (0.8, 0.4)
    assert got[2].avg_resolution_hours is None and got[2].volume_change == 1.0


@pytest.mark.parametrize("p1,recent,want", [(0, 0, 0.0), (1, 0, 0.3), (1, 1, 0.5), (4, 0, 1.0), (3, 2, 1.0)])
def test_p1_risk(spark, p1, recent, want):
    row = spark.range(1).select(tickets.p1_risk(F.lit(p1), F.lit(recent)).alias("r")).first()
    assert row.r == want


def test_volume_change_rounds_like_decimal_text(spark):
    pairs = [(1, 2000), (9, 80), (3, 16), (0, 3), (0, 0), (5, 0)]
    df = spark.createDataFrame(pairs, "recent bigint, older bigint")
    got = [r[0] for r in df.select(tickets.volume_change(F.col("recent"), F.col("older"))).collect()]
    want = [round((a - b) / b, 3) if b else (1.0 if a else 0.0) for a, b in pairs]
    assert got == want


def test_topics_links_and_timeline(spark):
    df = ticket_frame(spark, [
        (1, "2026-01-01", "p1", "resolved", 1.0, "REST API deprecation migration", "locale fallback"),
        (1, "2026-01-01", "p9", "open", 1.0, None, None),
    ])
    topics = [(r.ticket_id, r.event_type) for r in tickets.ticket_topics(df).collect()]
    assert topics == [("t0", "sdk_deprecation"), ("t0", "locale_fallback"), ("t0", "breaking_change")]
    assert [r.changelog_event for r in tickets.ticket_event_links(df).collect()] == ["rest_api_sunset"]
    assert [(r.marker, r.display_class) for r in tickets.ticket_timeline(df).collect()] == [("circle", "danger")]
    assert [(r.subject, r.tickets) for r in tickets.subject_counts(df).collect()] == [("REST API deprecation migration", 1)]


def test_nps(spark):
    scores = [0, 4, 5, 6, 7, 8, 9, 10, 11]
    risk = [1.0, 1.0, 0.7, 0.7, 0.3, 0.1, 0.0, 0.0, 0.0]
    rows = [(i, s, None, i) for i, s in enumerate(scores)]
    rows += [(20, 9, "we won't stay, frustrated", 1), (20, 3, "Great, we won", 2),  # last answer counts
             (21, 8, "Watching competitors", 3), (22, 5, "love it but done", 4), (23, None, "x", 5), (24, -7, "great", 6)]
    df = clean_nps(spark.createDataFrame(rows, "account_id bigint, score int, verbatim_comment string, ord bigint"))
    got = by_key(nps.nps_summary(df))
    assert [got[i].nps_detractor for i in range(9)] == risk
    assert got[8].nps_category == "nan" and not got[0].has_comment
    assert got[20].score == 3 and got[20].contradiction_type == nps.LOW_BUT_POSITIVE and got[20].nps_deterioration == 0.3
    assert got[21].nps_deterioration == 0.8 and "NPS 8 (Passive/Promoter)" in got[21].contradiction_detail
    assert got[22].contradiction_type is None and got[22].has_comment
    assert 23 not in got and got[24].score == -7
    accounts = spark.createDataFrame([(20,), (99,)], "account_id bigint")
    joined = by_key(nps.with_comments(accounts.join(nps.nps_summary(df), "account_id", "left"), df))
    assert joined[20].comment == "Great, we won" and joined[99].comment == ""
    histogram = {r.score: r.answers for r in nps.nps_histogram(df).collect()}
    assert len(histogram) == 11 and histogram[3] == 1 and histogram[1] == 0


def test_versions(spark):
    cfg = Config()
    cases = {
        "v3.1.2": (["sdk_deprecated", "rest_api_sunset", "locale_fallback_bug"], 0.7, 1.0),
        "v3.9.9": (["rest_api_sunset", "locale_fallback_bug"], 0.1, 0.0),
        "v4.0.0": (["sdk_risky_version", "breaking_change_impact", "locale_fallback_bug"], 0.3, 0.6),
        "v4.1.0": (["breaking_change_impact", "locale_fallback_bug"], 0.0, 0.0),
        "v4.2": (["locale_fallback_bug"], 0.0, 0.0), "v4.2.3": ([], 0.0, 0.0), "v4.10.0": ([], 0.0, 0.0),
        "v5.0-beta": ([], 0.0, 0.0), None: ([], 0.0, 0.0),
    }
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    version = F.col("v")
    rows = df.select(
        "v", product.version_impacts(version, cfg).alias("i"),
        product.product_risk(version, F.lit(0), cfg).alias("r"),
        product.product_risk(version, F.lit(9), cfg).alias("r9"),
        product.sdk_signal(version, cfg).alias("s"),
    ).collect()
    for r in rows:
        kinds, risk, signal = cases[r.v]
        assert [i["type"] for i in r.i] == kinds
        assert r.r == risk and r.s == signal and r.r9 == pytest.approx(min(1.0, risk + 0.3))


def test_event_impacts(spark):
    latest = spark.createDataFrame([(1, "v3.1.2"), (2, "v3.1.2"), (3, "v4.1.0"), (4, "v9.0.0")], "account_id bigint, sdk_version string")
    got = product.event_impacts(latest).groupBy("sdk_version").agg(F.count("*").alias("n"), F.max("accounts").alias("a"))
    assert {r.sdk_version: (r.n, r.a) for r in got.collect()} == {"v3.1.2": (5, 2), "v4.1.0": (4, 1), "v9.0.0": (2, 1)}
    assert product.events_table(spark).count() == 8
