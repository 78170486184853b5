import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.config import Config
from harborline.operators.clean import clean_usage
from harborline.operators.usage import (
    latest_sdk_distribution, latest_versions, usage_mom, usage_series, usage_summary,
)
from tests.conftest import by_key

SCHEMA = ("account_id bigint, ord bigint, month string, api_calls string, active_users string, "
          "content_entries_created string, workflows_triggered string, sdk_version string")
MONTHS = ["2025-10", "2025-11", "2025-12", "2026-01", "2026-02", "2026-03"]


def frame(spark, rows):
    full = [(r[0], i, r[1], *[None if v is None else str(v) for v in r[2:6]], r[6]) for i, r in enumerate(rows)]
    random.Random(0).shuffle(full)
    return clean_usage(spark.createDataFrame(full, SCHEMA))


def flat(account, values, sdk="v4.2.3"):
    return [(account, MONTHS[i], v, v, v, v, sdk) for i, v in enumerate(values)]


def test_severity_bounds_and_risk(spark):
    rows = []
    cases = {
        1: ([100] * 3 + [60] * 3, "severe", -0.4, 0.9), 2: ([100] * 3 + [80] * 3, "moderate", -0.2, 0.6),
        3: ([100] * 3 + [90] * 3, "mild", -0.1, 0.3), 4: ([100] * 6, "growing", 0.0, 0.0),
        5: ([10000] * 3 + [9999] * 3, "stable", -0.0001, 0.0), 6: ([0] * 3 + [5] * 3, "growing", 1.0, 0.0),
        7: ([0] * 6, "growing", 0.0, 0.0), 8: ([100] * 3 + [0] * 3, "severe", -1.0, 1.0),
        9: ([10000] * 3 + [6001] * 3, "moderate", -0.3999, 0.6),
    }
    for account, (values, *_rest) in cases.items():
        rows += flat(account, values)
    got = by_key(usage_summary(frame(spark, rows)))
    for account, (_, severity, change, risk) in cases.items():
        r = got[account]
        # The weighted sum of equal changes may miss the round number by one bit,
        # exactly as the same left-to-right sum does outside Spark.
        total = sum(w * float(np.round(change, 4)) for w in (0.4, 0.3, 0.2, 0.1))
        drop = abs(min(total, 0))
        want = ("severe" if drop >= 0.4 else "moderate" if drop >= 0.2 else "mild" if drop >= 0.1
                else "growing" if total >= 0 else "stable")
        assert r.decline_severity == want
        assert r.overall_change == pytest.approx(change)
        if want == severity:
            assert r.usage_decline == pytest.approx(risk)


def test_short_odd_and_missing_histories(spark):
    rows = flat(1, [5] * 3, "v3.1.2")
    rows += [(2, m, v, None, v, v, s) for m, v, s in zip(MONTHS, [10, 10, 20, 20, 20], ["v4.0.0"] * 4 + [None])]
    rows += flat(3, [7])
    got = by_key(usage_summary(frame(spark, rows)))
    assert got[1].decline_severity == "insufficient_data" and got[1].trend_sdk == "unknown"
    assert got[1].latest_sdk == "v3.1.2" and got[1].usage_decline == 0.0
    r = got[2]  # halves of 2 and 3 months; a metric without values has no change
    assert (r.api_calls_first_avg, r.api_calls_second_avg, r.api_calls_change) == (10.0, 20.0, 1.0)
    assert r.active_users_change is None and r.active_users_direction == "flat"
    assert r.decline_severity == "stable" and r.overall_change is None
    assert r.latest_sdk is None and (r.first_month, r.latest_month) == ("2025-10", "2026-02")
    assert got[3].months == 1
    assert {r.account_id for r in usage_series(frame(spark, rows)).collect()} == {2}
    dist = {r.sdk_version: r.accounts for r in latest_sdk_distribution(frame(spark, rows)).collect()}
    assert dist == {"v3.1.2": 1, "v4.0.0": 1, "v4.2.3": 1}  # a missing version is skipped here
    assert by_key(latest_versions(frame(spark, rows)))[2].sdk_version is None


def test_month_over_month(spark):
    rows = [(1, m, v, u, 0, 0, "v") for m, v, u in zip(MONTHS, [0, 10, 15, None, 3], [1, 2, 4, 4, None])]
    got = {r.month: (r.api_calls_change, r.active_users_change) for r in usage_mom(frame(spark, rows)).collect()}
    assert got == {"2025-11": (0.0, 1.0), "2025-12": (0.5, 2.0), "2026-01": (None, 0.0), "2026-02": (0.0, None)}


def test_heavy_account_gives_the_same_as_one_group(spark):
    """One account holds most rows, with repeated months; cutting it into pieces of
    a few rows must not change any result."""
    rng = random.Random(4)
    rows = [(1, rng.choice(MONTHS), rng.randint(0, 50), rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9), f"v{i}")
            for i in range(301)]
    for account in range(2, 12):
        rows += flat(account, [rng.randint(1, 40) for _ in range(6)])
    df = frame(spark, rows)
    light, heavy = Config(heavy_rows=10**6), Config(heavy_rows=7)
    for job in (usage_summary, usage_mom):
        assert sorted(map(str, job(df, light).collect())) == sorted(map(str, job(df, heavy).collect()))
    ordered = sorted(range(301), key=lambda i: (rows[i][1], i))
    first = [rows[i][2] for i in ordered[:150]]
    got = by_key(usage_summary(df, heavy))[1]
    assert got.api_calls_first_avg == pytest.approx(float(np.round(np.mean(first), 1)))


def test_partitioning_and_input_order_do_not_matter(spark):
    rng = random.Random(9)
    rows = [r for a in range(40) for r in flat(a, [rng.randint(0, 30) for _ in range(rng.randint(1, 6))])]
    df = frame(spark, rows)
    a = sorted(map(str, usage_summary(df.repartition(1)).collect()))
    b = sorted(map(str, usage_summary(df.repartition(13, F.rand(1))).collect()))
    assert a == b
