"""The whole scoring job: four grouped fact tables joined to the accounts.

Each fact table is aggregated to one row per account with mergeable aggregates,
then left-joined on ``account_id``; the joins reuse the partitioning of the
aggregates. The score itself is one column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import Config
from harborline.functions.num import clamp_unit, round_product, round_product_sql
from harborline.functions.running import with_position
from harborline.functions.text import quote
from harborline.operators.nps import (
    NO_ANSWER_DETERIORATION,
    NO_ANSWER_DETRACTOR,
    nps_summary,
)
from harborline.operators.notes import note_intelligence, note_signals
from harborline.operators.product import is_deprecated, is_risky, product_risk, sdk_signal
from harborline.operators.tickets import COUNTS, ticket_summary
from harborline.operators.usage import usage_summary

ACCOUNT_COLUMNS = [
    "account_id", "account_name", "arr", "plan_tier", "industry", "region", "csm_name",
    "contract_end_date", "days_to_renewal",
]


def account_signals(
    accounts: DataFrame, usage: DataFrame, tickets: DataFrame, nps: DataFrame,
    notes: DataFrame, cfg: Config = Config(), window_only: bool = True,
    note_facts: DataFrame | None = None,
) -> DataFrame:
    """Every account with its twelve signals and the facts behind them.

    ``notes`` carries ``matched_account_id``. ``note_facts`` may replace the
    keyword intelligence by a text model's (same columns, one row per account).
    """
    # Facts are aggregated before the join, so an account outside the window costs
    # one partial row per task; Catalyst may add a runtime filter on its own.
    if window_only:
        accounts = accounts.where("in_renewal_window")
    facts = note_facts if note_facts is not None else note_intelligence(notes)
    df = accounts.select(*ACCOUNT_COLUMNS)
    for side in (
        usage_summary(usage, cfg), ticket_summary(tickets, cfg), nps_summary(nps),
        note_signals(facts),
    ):
        df = df.join(side, "account_id", "left")
    return _with_defaults(df, cfg)


# What an account without any row in a source gets.
_DEFAULTS = {
    "decline_severity": "'insufficient_data'", "overall_change": "0D",
    "trend_sdk": "'unknown'", "current_sdk": "'unknown'",
    "volume_change": "0D", "nps_category": "'No Response'",
    "is_non_english": "false", "has_comment": "false", "contradiction_detected": "false",
    "note_count": "0L", "sentiment": "'unknown'", "sentiment_modifier": "0D",
    "competitors": "cast(array() AS array<string>)",
    "risk_factors": "cast(array() AS array<string>)", "renewal_signal": "'unknown'",
    "usage_decline": "0D", "competitor_mention": "0D", "p1_tickets": "0D",
    "nps_detractor": f"{NO_ANSWER_DETRACTOR}D", "open_tickets": "0D",
    "executive_escalation": "0D", "champion_loss": "0D",
    "nps_deterioration": f"{NO_ANSWER_DETERIORATION}D",
} | {count: "0L" for count in COUNTS}


def _default(name: str, source: str | None = None) -> str:
    return f"coalesce({source or name}, {_DEFAULTS[name]}) AS {name}"


def _with_defaults(df: DataFrame, cfg: Config) -> DataFrame:
    # Only accounts with usage have a version, and with it any product risk.
    version = F.col("latest_sdk")
    linked = F.coalesce("linked_tickets", F.lit(0))
    of_usage = df.withColumns({
        "_deprecated": is_deprecated(version, cfg), "_risky": is_risky(version, cfg),
        "_sdk_risk": sdk_signal(F.col("trend_sdk"), cfg),
        "_product_risk": F.when(F.col("months") > 0, product_risk(version, linked, cfg)),
    })
    return of_usage.selectExpr(
        *ACCOUNT_COLUMNS,
        "coalesce(months, 0L) AS months",
        *[_default(n) for n in ("decline_severity", "overall_change", "trend_sdk")],
        _default("current_sdk", "latest_sdk"),
        "api_calls_change", "active_users_change", "content_entries_change", "workflows_change",
        *[_default(n) for n in (*COUNTS, "volume_change")], "avg_resolution_hours",
        "score AS nps_score", "nps_ord", "contradiction_type", "contradiction_detail",
        *[_default(n) for n in (
            "nps_category", "is_non_english", "has_comment", "contradiction_detected",
            "note_count", "sentiment", "sentiment_modifier", "competitors", "risk_factors",
            "renewal_signal",
        )],
        "champion_status", "_deprecated AS is_deprecated_sdk", "_risky AS is_risky_sdk",
        # the twelve signals
        *[_default(n) for n in (
            "usage_decline", "competitor_mention", "p1_tickets", "nps_detractor", "open_tickets",
            "executive_escalation", "champion_loss", "nps_deterioration",
        )],
        "coalesce(budget_concern_risk, 0D) AS budget_concern",
        "_sdk_risk AS sdk_deprecation_risk",
        "coalesce(_product_risk, 0D) AS product_risk_impact",
        "coalesce(missed_qbrs_risk, 0D) AS missed_qbrs",
    )


def tier_of(total: Column, cfg: Config) -> Column:
    return (
        F.when(total >= cfg.high_threshold, "High")
        .when(total >= cfg.medium_threshold, "Medium").otherwise("Low")
    )


def with_score(signals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds risk_score, risk_tier, score_breakdown and top_risk_drivers. The tier
    is taken from the unrounded sum; a missing signal counts as 0."""
    parts, entries = [], []
    for rank, (name, weight, label) in enumerate(cfg.signals):
        value = f"coalesce({name}, 0D)"
        parts.append(f"{value} * {weight}D")
        entries.append(
            f"named_struct('ord', {rank}, 'signal', {quote(name)}, 'label', {quote(label)}, "
            f"'raw_score', {round_product_sql(value, 3)}, 'weight', {weight}D, "
            f"'contribution', {round_product_sql(parts[-1], 4)})"
        )
    total = F.expr("0D + " + " + ".join(parts))
    df = signals.withColumns({
        "_total": clamp_unit(total), "score_breakdown": F.expr(f"array({', '.join(entries)})"),
    })
    return df.withColumns({
        "risk_score": round_product(F.col("_total"), 4),
        "risk_tier": tier_of(F.col("_total"), cfg),
        "top_risk_drivers": top_drivers(F.col("score_breakdown")),
    }).drop("_total")


def top_drivers(breakdown: Column, n: int = 5) -> Column:
    """The n largest positive contributions; equal ones keep the signal order."""
    positive = F.filter(breakdown, lambda d: d["contribution"] > 0)
    keyed = F.transform(positive, lambda d: F.struct(-d["contribution"], d["ord"], d.alias("driver")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda k: k["driver"])


def score_accounts(
    accounts: DataFrame, usage: DataFrame, tickets: DataFrame, nps: DataFrame,
    notes: DataFrame, cfg: Config = Config(), window_only: bool = True,
    note_facts: DataFrame | None = None,
) -> DataFrame:
    """Scored accounts, unordered; ``ranked`` puts them in report order."""
    signals = account_signals(accounts, usage, tickets, nps, notes, cfg, window_only, note_facts)
    return with_score(signals, cfg)


def _report_order() -> list[Column]:
    return [F.desc("risk_score"), F.asc("account_id")]


def ranked(scored: DataFrame) -> DataFrame:
    return scored.orderBy(*_report_order())


def with_rank(scored: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of an account in report order from 0. Accounts are dealt out by ranges
    of that order, so no task sees them all."""
    return with_position(scored, _report_order(), "rank")
