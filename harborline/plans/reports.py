"""Portfolio reports over the scored accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline import config as c
from harborline.config import Config
from harborline.functions.num import fixed_text, money_text
from harborline.operators.clean import in_window
from harborline.plans.scoring import ranked


def view(
    scored: DataFrame, cfg: Config = Config(), show_all: bool = False,
    tiers=c.TIERS, plans=None,
) -> DataFrame:
    """The accounts in view: renewal window (or all), then tier and plan filters."""
    df = scored if show_all else scored.where(in_window(F.col("days_to_renewal"), cfg))
    df = df.where(F.col("risk_tier").isin(*tiers))
    return df if plans is None else df.where(F.col("plan_tier").isin(*plans))


def plan_tiers(scored: DataFrame) -> DataFrame:
    return scored.select("plan_tier").distinct().orderBy("plan_tier")


def view_counts(scored: DataFrame, cfg: Config = Config()) -> DataFrame:
    inside = in_window(F.col("days_to_renewal"), cfg)
    return scored.agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(inside).alias("accounts_in_window")
    )


def _of_tier(tier: str) -> Column:
    return F.col("risk_tier") == tier


def _arr_of(tier: str) -> Column:
    return F.coalesce(F.sum(F.when(_of_tier(tier), F.col("arr"))), F.lit(0).cast("decimal(28,2)"))


def tier_totals(scored: DataFrame) -> DataFrame:
    """Accounts and revenue per tier, High to Low, zero-filled."""
    per_tier = [
        F.struct(
            F.lit(rank).alias("ord"), F.lit(tier).alias("risk_tier"),
            F.count_if(_of_tier(tier)).alias("accounts"), _arr_of(tier).alias("arr"),
        )
        for rank, tier in enumerate(c.TIERS)
    ]
    return scored.agg(F.array(*per_tier).alias("t")).selectExpr("inline(t)")


def kpis(scored: DataFrame) -> DataFrame:
    """High and medium counts, revenue at risk, and the mean score (0 if empty)."""
    points = F.sum(F.col("risk_score").cast("decimal(18,4)")).cast("double")
    return scored.agg(
        F.count_if(_of_tier("High")).alias("high_risk_accounts"),
        F.count_if(_of_tier("Medium")).alias("medium_risk_accounts"),
        (_arr_of("High") + _arr_of("Medium")).alias("arr_at_risk"),
        F.coalesce(F.try_divide(points, F.count(F.lit(1))), F.lit(0.0)).alias("avg_risk_score"),
    )


def portfolio_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.count_if(_of_tier("High")).alias("high_risk_count"),
        _arr_of("High").alias("high_risk_arr"),
        F.count_if(_of_tier("Medium")).alias("medium_risk_count"),
        _arr_of("Medium").alias("medium_risk_arr"),
        F.count_if(_of_tier("Low")).alias("low_risk_count"),
    )


def heatmap(scored: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` accounts by score with nine signals, and one text per cell."""
    name = F.concat(
        F.col("account_name"), F.lit(" ("), F.substring("risk_tier", 1, 1), F.lit(")")
    )
    signals = [s for s, _ in c.HEATMAP_SIGNALS]
    cells = [fixed_text(F.col(s), 2).alias(f"{s}_text") for s in signals]
    return ranked(scored).limit(top).select("account_id", name.alias("row_label"), *signals, *cells)


def heatmap_long(scored: DataFrame, top: int = 20) -> DataFrame:
    """The heat map as one row per cell, with the column label."""
    rows = heatmap(scored, top)
    cells = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("signal_label"), F.col(s).alias("value"))
        for i, (s, label) in enumerate(c.HEATMAP_SIGNALS)
    ])
    return rows.select("account_id", "row_label", F.inline(cells))


def top_high_risk(scored: DataFrame, top: int = 10) -> DataFrame:
    high = scored.where(_of_tier("High"))
    return ranked(high).limit(top).select(
        "account_id", "account_name", "risk_score", "arr", "plan_tier"
    )


def risk_table(scored: DataFrame) -> DataFrame:
    """The account list as shown: formatted texts, report column names."""
    return ranked(scored).select(
        F.col("account_name").alias("Account"), F.col("risk_tier").alias("Risk"),
        fixed_text(F.col("risk_score"), 3).alias("Score"), money_text(F.col("arr")).alias("ARR"),
        F.col("plan_tier").alias("Plan"), F.col("days_to_renewal").alias("Days to Renewal"),
        F.col("csm_name").alias("CSM"), F.col("region").alias("Region"),
    )


def account_labels(scored: DataFrame) -> DataFrame:
    label = F.concat(
        F.col("account_name"), F.lit(" ("), F.col("risk_tier"), F.lit(") — Score: "),
        fixed_text(F.col("risk_score"), 3),
    )
    return scored.select("account_id", label.alias("label"))


def breakdown_long(scored: DataFrame) -> DataFrame:
    """Positive contributions, one row each, with their display class. Order by
    contribution descending, then ord, for the chart of one account."""
    value = F.col("contribution")
    shown = scored.select("account_id", F.inline("score_breakdown")).where(value > 0)
    return shown.withColumn(
        "display_class",
        F.when(value > 0.1, "danger").when(value > 0.05, "warning").otherwise("info"),
    )


def drivers_long(scored: DataFrame) -> DataFrame:
    """Top drivers, one row per account and rank."""
    rows = scored.select("account_id", F.posexplode("top_risk_drivers").alias("pos", "d"))
    return rows.select(
        "account_id", (F.col("pos") + 1).alias("driver_rank"), F.col("d.signal").alias("signal"),
        F.col("d.label").alias("label"), F.col("d.raw_score").alias("raw_score"),
        F.col("d.weight").alias("weight"), F.col("d.contribution").alias("contribution"),
    )


def sdk_impact(scored: DataFrame) -> DataFrame:
    """Accounts on deprecated or risky versions, with their linked tickets."""
    hit = scored.where(F.col("is_deprecated_sdk") | F.col("is_risky_sdk"))
    return hit.select(
        "account_id", F.col("account_name").alias("Account"), F.col("current_sdk").alias("SDK"),
        F.when(F.col("is_deprecated_sdk"), "Deprecated").otherwise("Risky").alias("Risk"),
        money_text(F.col("arr")).alias("ARR"),
        F.concat(F.col("days_to_renewal").cast("string"), F.lit(" days")).alias("Renewal"),
        # Tickets link to a version only where the account has usage.
        F.col("linked_tickets").alias("Linked Tickets"),
    )


def arr_deprecated(scored: DataFrame) -> DataFrame:
    on_deprecated = F.sum(F.when(F.col("is_deprecated_sdk"), F.col("arr")))
    return scored.agg(
        F.coalesce(on_deprecated, F.lit(0).cast("decimal(28,2)")).alias("arr_on_deprecated"),
        F.count_if("is_deprecated_sdk").alias("accounts_on_deprecated"),
    )


def cohorts(scored: DataFrame) -> DataFrame:
    """Accounts in each insight cohort; an account may be in several."""
    declining = F.col("decline_severity").isin("mild", "moderate", "severe")
    rules = (
        ("silent_churn", (F.col("nps_score") >= 7) & declining),
        ("sdk_cluster", F.col("is_deprecated_sdk")),
        ("contradiction", F.col("contradiction_detected")),
        ("merger", F.array_contains("risk_factors", F.lit("M&A activity"))),
        ("champion_at_risk", F.col("champion_status") == "at_risk"),
    )
    member = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return scored.select(
        F.explode(member).alias("cohort"), "account_id", "risk_tier", "risk_score"
    )
