"""Prompt texts for the optional text model, and the texts used without one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.num import fixed_text, money_text

JSON_ONLY = "Answer with one JSON object and nothing else."


def fill(template: str, **values: Column) -> Column:
    """Concatenates a template's literal pieces and its named columns."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


NOTE_TASK = """Read the call notes below, written by an account owner, and report only what they state.

Account {account_name} (id {account_id}), plan {plan_tier}, revenue {arr}, contract ends {contract_end}.

Notes:
{note_text}

Fields of the JSON object:
- sentiment: positive, neutral, negative or mixed
- competitors: names of rival products that are mentioned
- risk_factors: risks to the renewal, short phrases
- executive_involved: true if a director, vice president or chief officer takes part
- budget_concern: true if budget cuts or price complaints are mentioned
- renewal_signal: positive, negative, neutral or mixed
- champion_status: active, at_risk, lost or unknown
- missed_qbrs: number of missed review meetings
- action_items: urgent next steps
- key_quote: the most telling sentence
""" + JSON_ONLY

TRANSLATION_TASK = """Translate this customer comment into English and keep its tone.

Comment: {comment}

Fields of the JSON object: translation, original_language, sentiment (positive, neutral,
negative or mixed), risk_signals (list of phrases).
""" + JSON_ONLY

NOTES_OVERVIEW_TASK = """Summarise the renewal risks in the following call notes.

{notes}

Fields of the JSON object: high_risk_accounts (list of objects with account_name, risk_level,
key_risks, competitors_mentioned, executive_involved), portfolio_themes (list),
urgent_actions (list).
""" + JSON_ONLY

EXPLANATION_TASK = """You advise an account team before a renewal.

Account {account_name} (id {account_id}), plan {plan_tier}, revenue {arr}, region {region},
owner {csm_name}. The contract ends {contract_end}, in {days_to_renewal} days.
Usage: {usage_summary}
Tickets: {ticket_summary}
Survey: {nps_summary}
Call notes: {csm_intelligence}
Product changes: {product_risk_summary}
Risk score {risk_score} of 1.0, tier {risk_tier}.

Give: the situation in two or three sentences; three to five drivers with reasons; one signal
that is easily missed; concrete actions for two weeks; your confidence.
"""

SILENT_CHURN_TASK = """Does this account look healthy while quietly leaving?

Account {account_name}. Survey score {nps_score}, comment "{nps_comment}".
Change of API calls {api_trend}%, active users {user_trend}%, content {content_trend}%.
Call notes: {csm_intelligence}

Fields of the JSON object: is_silent_churn, confidence (0 to 1), pattern_type, evidence (list),
counter_evidence (list), recommended_investigation.
""" + JSON_ONLY

PORTFOLIO_TASK = """Summarise this renewal portfolio for the leadership team.

{total_accounts} accounts: {high_risk_count} high risk ({high_risk_arr}), {medium_risk_count}
medium risk ({medium_risk_arr}), {low_risk_count} low risk.
Top accounts:
{top_risk_accounts}
Signals: {portfolio_signals}
Product events: {product_risk_events}

Give: a summary, three themes, the effect of version deprecations, actions, an expected
renewal rate.
"""

# The report texts used when no model answers.
EXPLANATION_TEXT = """## Risk Assessment for {account_name}

**Risk Tier: {risk_tier}** (Score: {risk_score}/1.0)

### Usage Analysis
{usage_summary}

### Support Ticket Analysis
{ticket_summary}

### NPS Analysis
{nps_summary}

### CSM Intelligence
{csm_intelligence}

### Product Risk Impact
{product_risk_summary}

---
*Note: Configure a text model for strategic analysis and recommendations.*"""

PORTFOLIO_TEXT = """## Portfolio Summary

- **{total_accounts}** accounts in the renewal window
- **{high_risk_count} High Risk** accounts with **{high_risk_arr}** ARR at risk
- **{medium_risk_count} Medium Risk** accounts with **{medium_risk_arr}** ARR at risk  
- **{low_risk_count} Low Risk** accounts on track for renewal

*Configure a text model for strategic portfolio insights.*"""

# The silent-churn answer when no model answers.
SILENT_CHURN_FALLBACK = {
    "is_silent_churn": False, "confidence": 0.0, "pattern_type": "analysis_unavailable",
    "evidence": ["Text model not configured — manual review recommended"],
    "counter_evidence": [],
    "recommended_investigation": "Configure a text model for automated silent churn detection",
}


def account_values() -> dict[str, Column]:
    """Columns of a scored account with summaries, as prompt values."""
    same = (
        "account_id", "account_name", "plan_tier", "region", "csm_name", "days_to_renewal",
        "usage_summary", "ticket_summary", "nps_summary", "csm_intelligence",
        "product_risk_summary", "risk_tier",
    )
    values = {name: F.col(name) for name in same}
    return values | {
        "risk_score": fixed_text(F.col("risk_score"), 2),
        "arr": money_text(F.col("arr")),
        "contract_end": F.date_format("contract_end_date", "yyyy-MM-dd HH:mm:ss"),
    }


def portfolio_values() -> dict[str, Column]:
    counts = ("total_accounts", "high_risk_count", "medium_risk_count", "low_risk_count")
    return {name: F.col(name) for name in counts} | {
        "high_risk_arr": money_text(F.col("high_risk_arr")),
        "medium_risk_arr": money_text(F.col("medium_risk_arr")),
    }
