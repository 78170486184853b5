"""Usage history: trend, month-over-month change, decline severity and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import Config
from harborline.functions.num import round_product, round_product_sql
from harborline.functions.order import latest, with_positions

# Metric column, short name in results, weight in the overall
# change (summed in this order).
TREND_METRICS = (
    ("api_calls", "api_calls", 0.40),
    ("active_users", "active_users", 0.30),
    ("content_entries_created", "content_entries", 0.20),
    ("workflows_triggered", "workflows", 0.10),
)
_CARRY = ["api_calls", "active_users"]


def usage_positions(usage: DataFrame, cfg: Config) -> DataFrame:
    columns = ["account_id", "month", "month_dt", "ord", "sdk_version"]
    columns += [m for m, _, _ in TREND_METRICS]
    return with_positions(
        usage.select(*columns), "account_id", "month_dt", "ord", _CARRY, cfg.heavy_rows
    )


def _change_sql(name: str) -> str:
    """Relative change of the second half to the first, safe for a zero start."""
    first, second = f"{name}_first", f"{name}_second"
    return (
        f"CASE WHEN {first} = 0 THEN if({second} = 0, 0D, 1D) "
        f"ELSE try_divide({second} - {first}, {first}) END AS {name}_raw"
    )


def _direction_sql(change: str) -> str:
    return f"CASE WHEN {change} > 0.05D THEN 'up' WHEN {change} < -0.05D THEN 'down' ELSE 'flat' END"


def _severity_sql(overall: str, cfg: Config) -> str:
    drop = f"abs(least({overall}, 0D))"
    return (
        f"CASE WHEN {overall} IS NULL THEN 'stable' "
        f"WHEN {drop} >= {cfg.decline_severe}D THEN 'severe' "
        f"WHEN {drop} >= {cfg.decline_moderate}D THEN 'moderate' "
        f"WHEN {drop} >= {cfg.decline_mild}D THEN 'mild' "
        f"WHEN {overall} >= 0 THEN 'growing' ELSE 'stable' END"
    )


USAGE_RISK_SQL = """CASE decline_severity WHEN 'mild' THEN 0.3D WHEN 'moderate' THEN 0.6D
    WHEN 'severe' THEN least(1D, 0.7D + abs(overall_change) * 0.5D) ELSE 0D END"""


def usage_summary(usage: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per account with usage. ``latest_sdk`` is known from one month on;
    the trend columns and ``trend_sdk`` need ``min_usage_months`` months."""
    early = "pos <= series_length div 2"
    halves = []
    for metric, name, _ in TREND_METRICS:
        halves += [
            f"avg(if({early}, {metric}, NULL)) AS {name}_first",
            f"avg(if({early}, NULL, {metric})) AS {name}_second",
        ]
    per_account = usage_positions(usage, cfg).groupBy("account_id").agg(
        *[F.expr(sql) for sql in (
            "count(1) AS months",
            "max_by(sdk_version, struct(month_dt, ord)) AS latest_sdk",
            "max_by(month, struct(month_dt, ord)) AS latest_month",
            "min_by(month, struct(month_dt, ord)) AS first_month",
            *halves,
        )]
    )
    names = [name for _, name, _ in TREND_METRICS]
    changed = per_account.selectExpr("*", *[_change_sql(name) for name in names])
    overall = "0D + " + " + ".join(
        f"{round_product_sql(f'{name}_raw', 4)} * {weight}D" for _, name, weight in TREND_METRICS
    )
    weighed = changed.selectExpr(
        "*", f"{overall} AS _overall", f"months >= {cfg.min_usage_months} AS _enough"
    )
    trends = []
    for name in names:
        for column, sql in (
            ("first_avg", round_product_sql(f"{name}_first", 1)),
            ("second_avg", round_product_sql(f"{name}_second", 1)),
            ("change", round_product_sql(f"{name}_raw", 4)),
            ("direction", _direction_sql(f"{name}_raw")),
        ):
            trends.append(f"if(_enough, {sql}, NULL) AS {name}_{column}")
    out = weighed.selectExpr(
        "account_id", "months", "latest_sdk", "latest_month", "first_month", *trends,
        f"if(_enough, {round_product_sql('_overall', 4)}, 0D) AS overall_change",
        f"if(_enough, {_severity_sql('_overall', cfg)}, 'insufficient_data') AS decline_severity",
        "if(_enough, latest_sdk, 'unknown') AS trend_sdk",
    )
    return out.selectExpr("*", f"{USAGE_RISK_SQL} AS usage_decline")


def usage_mom(usage: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Month-over-month change of every month that has a predecessor."""
    before = F.col("prev.api_calls")
    change = F.when(before > 0, (F.col("api_calls") - before) / before).otherwise(F.lit(0.0))
    return (
        usage_positions(usage, cfg)
        .where(F.col("pos") > 1)
        .select(
            "account_id", "month",
            round_product(change, 4).alias("api_calls_change"),
            (F.col("active_users") - F.col("prev.active_users")).alias("active_users_change"),
        )
    )


def usage_series(usage: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Monthly rows for charts; an account with too short a history shows none."""
    lengths = usage.groupBy("account_id").agg(F.count(F.lit(1)).alias("_n"))
    enough = lengths.where(F.col("_n") >= cfg.min_usage_months).select("account_id")
    return usage.join(enough, "account_id", "left_semi").select(
        "account_id", "month", "month_dt", "api_calls", "active_users", "content_entries_created"
    )


def latest_sdk_distribution(usage: DataFrame) -> DataFrame:
    """Accounts per latest known version (months without a version are skipped)."""
    known = usage.where(F.col("sdk_version").isNotNull())
    per_account = known.groupBy("account_id").agg(
        latest(F.col("sdk_version"), "month_dt", "ord").alias("sdk_version")
    )
    counts = per_account.groupBy("sdk_version").agg(F.count(F.lit(1)).alias("accounts"))
    return counts.withColumn("display_class", sdk_class(F.col("sdk_version"))).orderBy("sdk_version")


def latest_versions(usage: DataFrame) -> DataFrame:
    """Version of each account's last month, also where it is missing."""
    return usage.groupBy("account_id").agg(
        latest(F.col("sdk_version"), "month_dt", "ord").alias("sdk_version")
    )


def sdk_class(version: Column) -> Column:
    return (
        F.when(F.startswith(version, F.lit("v3")), "danger")
        .when(version == "v4.0.0", "warning")
        .when(version == "v4.1.0", "info")
        .otherwise("success")
    )
