"""The registered queries: name -> function of (spark, data folder)."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.config import SIGNALS
from harborline.operators import enrich, nps, product, tickets, usage
from harborline.operators.notes import marked_notes, note_intelligence, note_signals
from harborline.functions.digest import sum_digest
from harborline.functions.lineage import shared_folder
from harborline.operators.reconcile import match_by_id, reconcile_notes
from harborline.operators.replies import ReplyStore
from harborline.plans import account_store, details, reports
from harborline.plans.scoring import score_accounts, with_rank
from harborline.sources import readers
from workload import standins
from workload.fixtures import Inputs

SIGNAL_NAMES = [name for name, _, _ in SIGNALS]


def _double(*columns: str) -> dict:
    return {c: F.col(c).cast("double") for c in columns}


def _joined(column: str, separator: str = ", "):
    return F.array_join(column, separator).alias(column)


def accounts_window(i: Inputs) -> DataFrame:
    return i.accounts.where("in_renewal_window").select(
        "account_id", "account_name", "plan_tier", "industry", "csm_name", "region",
        F.col("arr").cast("double").alias("arr"),
        F.col("contract_end_date").cast("string").alias("contract_end_date"), "days_to_renewal",
    )


def usage_trend(i: Inputs) -> DataFrame:
    return usage.usage_summary(i.usage, i.cfg).drop("usage_decline")


def usage_risk(i: Inputs) -> DataFrame:
    return usage.usage_summary(i.usage, i.cfg).select(
        "account_id", "decline_severity", "usage_decline"
    )


def usage_series(i: Inputs) -> DataFrame:
    return usage.usage_series(i.usage, i.cfg).withColumn("month_dt", F.col("month_dt").cast("string"))


def ticket_metrics(i: Inputs) -> DataFrame:
    return tickets.ticket_summary(i.tickets, i.cfg).drop("p1_tickets", "open_tickets")


def ticket_risk(i: Inputs) -> DataFrame:
    return tickets.ticket_summary(i.tickets, i.cfg).select("account_id", "p1_tickets", "open_tickets")


def ticket_timeline(i: Inputs) -> DataFrame:
    day = F.to_date("created_date").cast("string")
    return tickets.ticket_timeline(i.tickets).withColumn("created_date", day)


def nps_bands(i: Inputs) -> DataFrame:
    return i.nps.select(
        "ord", "account_id", "score", "nps_category", "is_non_english",
        F.length("verbatim_comment").cast("bigint").alias("comment_length"),
    )


def nps_contradiction(i: Inputs) -> DataFrame:
    return nps.nps_summary(i.nps).select(
        "account_id", F.col("score").alias("nps_score"), "nps_category", "has_comment",
        "is_non_english", "contradiction_detected", "contradiction_type", "contradiction_detail",
    )


def nps_risk(i: Inputs) -> DataFrame:
    return nps.nps_summary(i.nps).select("account_id", "nps_detractor", "nps_deterioration")


def _latest_versions(i: Inputs) -> DataFrame:
    return usage.latest_versions(i.usage)


def version_impacts(i: Inputs) -> DataFrame:
    counted = _latest_versions(i).groupBy("sdk_version").agg(F.count(F.lit(1)).alias("accounts"))
    impacts = F.inline(product.version_impacts(F.col("sdk_version"), i.cfg))
    return counted.select("sdk_version", "accounts", impacts)


def product_risk(i: Inputs) -> DataFrame:
    return i.scored.select(
        "account_id", "current_sdk", "is_deprecated_sdk", "is_risky_sdk", "linked_tickets",
        "sdk_deprecation_risk", "product_risk_impact",
    )


def note_extract(i: Inputs) -> DataFrame:
    return i.notes.select("ord", "account_id", "account_name_raw", "date_raw", "csm_name")


def _note_intelligence(i: Inputs) -> DataFrame:
    return note_intelligence(i.known_notes).select(
        "account_id", "sentiment", _joined("competitors"), _joined("risk_factors", "; "),
        "executive_involved", "budget_concern", "renewal_signal", "champion_status",
        "missed_qbrs", "note_count",
    )


def _note_signals(i: Inputs) -> DataFrame:
    return note_signals(note_intelligence(i.known_notes)).select(
        "account_id", "competitor_mention", "executive_escalation", "budget_concern_risk",
        "champion_loss", "missed_qbrs_risk", "sentiment_modifier",
    )


def reconcile_id(i: Inputs) -> DataFrame:
    matched = match_by_id(i.notes, i.accounts)
    return matched.where(F.col("matched_account_id").isNotNull()).select(
        "ord", "account_id", "matched_account_id", "matched_account_name"
    )


def reconcile_fuzzy(i: Inputs) -> DataFrame:
    # The notes are written and dealt out several times, so they go without their text and with the columns of the result.
    return reconcile_notes(i.notes.select("ord", "account_id", "account_name_raw"), i.accounts, i.cfg).select(
        "ord", "account_id", "account_name_raw", "matched_account_id", "matched_account_name",
        "match_method", "match_confidence",
    )


def account_scores(i: Inputs) -> DataFrame:
    # The ranking writes whole rows, so it gets the columns of the result only.
    scored = i.fresh_scores.select(
        "account_id", "account_name", "arr", "plan_tier", "industry", "region", "csm_name",
        "contract_end_date", "days_to_renewal", "risk_score", "risk_tier", *SIGNAL_NAMES,
    )
    return with_rank(scored).orderBy("rank").withColumns(
        _double("arr") | {"contract_end_date": F.col("contract_end_date").cast("string")}
    )


def account_scores_window(i: Inputs) -> DataFrame:
    scored = score_accounts(i.accounts, i.usage, i.tickets, i.nps, i.known_notes, i.cfg)
    return scored.select("account_id", "risk_score", "risk_tier", *SIGNAL_NAMES)


def account_scores_reconciled(i: Inputs) -> DataFrame:
    """From raw note text to scores, with the notes matched by id or name."""
    texts = ("ord", "raw_text", "account_id", "account_name_raw")
    # No name is given to what is reconciled, so that its shuffles can go before the names are matched.
    notes = reconcile_notes(marked_notes(i.notes.select(*texts)), i.accounts, i.cfg)
    scored = score_accounts(i.accounts, i.usage, i.tickets, i.nps, notes, i.cfg, window_only=False)
    return scored.select("account_id", "note_count", "risk_score", "risk_tier", *SIGNAL_NAMES)


def _in_view(i: Inputs) -> DataFrame:
    return reports.view(i.scored, i.cfg)


#: The fields of each section that the digests of ``account_360`` cover.
BUNDLE_FIELDS = {
    "account": ("account_name", "arr", "plan_tier", "industry", "csm_name", "region", "contract_end_date", "ord", "days_to_renewal", "in_renewal_window"),
    "usage": ("ord", "month", "month_dt", "api_calls", "active_users", "content_entries_created", "workflows_triggered", "sdk_version"),
    "tickets": ("ticket_id", "priority", "status", "resolution_time_hours", "subject", "description", "is_unresolved"),
    "nps": ("ord", "score", "verbatim_comment", "nps_category", "is_non_english"),
    "notes": ("ord", "raw_text"),
}


def account_360(i: Inputs) -> DataFrame:
    """The bundle's rows and a digest of their fields, by account and section."""
    rows = details.account_bundle(i.accounts, i.usage, i.tickets, i.nps, i.known_notes)

    def field(name):
        value = F.get_json_object("payload", f"$.{name}")
        # JSON numbers drop zeros at the end.
        return F.coalesce(value.cast("decimal(18,2)").cast("string") if name == "arr" else value, F.lit("~"))

    def fields(names):
        return F.concat_ws("|", *map(field, names))

    texts = [F.when(F.col("section") == name, fields(names)) for name, names in BUNDLE_FIELDS.items()]
    return details.bundle_digests(rows, F.coalesce(*texts))


def account_page(i: Inputs) -> DataFrame:
    """The stored detail page of the account at the head of the ranking."""
    path = f"{shared_folder(i.spark)}/pages-{uuid.uuid4().hex}"
    account_store.write_pages(path, i.scored, i.usage, i.tickets, i.known_notes.withColumns({
        "match_method": F.lit("known"), "match_confidence": F.lit(100.0),
    }), i.cfg)
    headers = i.spark.read.parquet(f"{path}/header")
    first = headers.orderBy(F.desc(F.col("score").cast("double")), "account_id").select("account_id").first()
    page = account_store.read_page(i.spark, path, first.account_id if first else -1)
    shown = {
        "header": ("account_name", "risk_tier", "score", "arr", "plan_tier", "days_to_renewal", "csm_name", "region", "decline_severity",
                   "overall_change", "sdk_version", "usage_summary", "ticket_summary", "nps_summary", "csm_intelligence", "product_risk_summary"),
        "breakdown": ("rank", "signal", "label", "display_class"), "usage": ("month", "api_calls", "active_users", "content_entries_created"),
        "tickets": ("ticket_id", "priority", "subject", "marker", "display_class"), "notes": ("ord", "raw_text"),
    }
    text = F.coalesce(*(
        F.when(F.col("section") == name, F.concat_ws("|", *(F.coalesce(F.get_json_object("payload", f"$.{n}"), F.lit("~")) for n in names)))
        for name, names in shown.items()
    ))
    return account_store.page_rows(page).select("section", "account_id", text.alias("text"))


def unresolved_tickets(i: Inputs) -> DataFrame:
    return i.tickets.groupBy("is_unresolved", "status").agg(F.count(F.lit(1)).alias("tickets"))


def filtered_view(i: Inputs) -> DataFrame:
    """All accounts or those in the window, of one tier and of each plan: the three filters of the list."""
    views = []
    for show_all in (True, False):
        for tier in ("High", "Medium", "Low"):
            seen = reports.view(i.scored, i.cfg, show_all=show_all, tiers=(tier,), plans=("BUILDING", "MACHINERY"))
            views.append(seen.groupBy("plan_tier").agg(F.count(F.lit(1)).alias("accounts"), F.sum("arr").cast("double").alias("arr"))
                         .select(F.lit(show_all).alias("show_all"), F.lit(tier).alias("tier"), "plan_tier", "accounts", "arr"))
    return reduce(DataFrame.unionByName, views)


def note_prompts(i: Inputs) -> DataFrame:
    """The prompts that a model would get for each account's notes, as length and digest."""
    texts = enrich.account_texts(i.known_notes, i.cfg).join(i.accounts, "account_id")
    prompt = enrich.note_prompt()
    return texts.select("account_id", "part", "note_count", F.length(prompt).alias("characters"), F.md5(prompt.cast("binary")).alias("prompt_md5"))


def tickets_lenient(i: Inputs) -> DataFrame:
    """Tickets by way of CSV files with two orders of columns, one of them without descriptions, and with
    dates that are none: the rows, and the rejected fields with their text."""
    folder = f"{shared_folder(i.spark)}/tickets-{uuid.uuid4().hex}"
    date = F.when(F.col("account_id") % 50 == 7, F.concat(F.lit("about "), F.col("created_date"))).otherwise(F.col("created_date").cast("string"))
    raw = i.raw_tickets.withColumn("created_date", date)
    even = F.col("account_id") % 2 == 0
    raw.where(even).write.option("header", True).csv(f"{folder}/ordered")
    turned = [c for c in reversed(raw.columns) if c != "description"]
    raw.where(~even).select(*turned).write.option("header", True).csv(f"{folder}/turned")
    rows, rejects = readers.read_lenient(i.spark, "tickets", [f"{folder}/ordered", f"{folder}/turned"])
    none = F.lit(None).cast("string")
    return rows.select(
        "ticket_id", "account_id", F.to_date("created_date").cast("string").alias("created_date"), "priority", "status", "subject", "description",
        none.alias("column"), none.alias("raw_text"), none.alias("reason"),
    ).unionByName(rejects.select("column", "raw_text", "reason"), allowMissingColumns=True)


def _on_one_line(column: str):
    return F.regexp_replace(column, r"[\r\n]", " ")


def read_all_inputs(i: Inputs) -> DataFrame:
    """All inputs by way of files, as users keep them: the rows of each and a digest of their main fields."""
    folder = f"{shared_folder(i.spark)}/inputs-{uuid.uuid4().hex}"
    names = ("accounts", "usage", "tickets", "nps", "csm_notes", "changelog")
    paths = {name: f"{folder}/{name}" for name in names}
    raw = {
        "accounts": i.raw("fx_accounts"), "usage": i.raw("fx_usage"), "tickets": i.raw_tickets,
        "nps": i.raw("fx_nps").withColumn("verbatim_comment", _on_one_line("verbatim_comment")),
    }
    for name, df in raw.items():
        df.drop("ord").write.option("header", True).option("escape", '"').csv(paths[name])
    # One record a row; the separators of records do not occur inside them.
    records = F.concat(F.regexp_replace("raw_text", "-{2,}", "- "), F.lit("\n---"))
    i.note_records.repartitionByRange("ord").sortWithinPartitions("ord").select(records).write.text(paths["csm_notes"])
    events = product.events_table(i.spark, i.cfg)
    events.select(F.concat_ws(" ", "version", "date", "title")).write.text(paths["changelog"])
    read = readers.read_all(i.spark, paths, i.cfg)
    fields = {
        "accounts": ("account_id", "account_name", "plan_tier", "arr", "contract_end_date", "in_renewal_window"),
        "usage": ("account_id", "month", "api_calls", "workflows_triggered", "sdk_version"),
        "tickets": ("ticket_id", "account_id", "priority", "status", "resolution_time_hours", "subject"),
        "nps": ("account_id", "score", "verbatim_comment", "nps_category"),
        "csm_notes": ("raw_text",), "changelog": ("line",),
    }
    return reduce(DataFrame.unionByName, [
        read[name].agg(F.count(F.lit(1)).alias("rows"), sum_digest(F.concat_ws("|", *(
            F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns
        ))).alias("digest")).select(F.lit(name).alias("input"), "rows", "digest")
        for name, columns in fields.items()
    ])


# --- enrichment, with a model stand-in ---------------------------------------


def stub_client():
    """A deterministic model stand-in: it fails for long prompts (those rows fall
    back) and wraps its other answers in a code fence."""
    def client(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            return "not json"
        answer = {
            "sentiment": "negative", "competitors": ["Strapi"] if "Strapi" in prompt else [],
            "risk_factors": ["read by the stand-in"], "executive_involved": "VP" in prompt,
            "budget_concern": "budget" in prompt, "renewal_signal": "mixed",
            "champion_status": "lost" if "lost faith" in prompt else "unknown", "missed_qbrs": 1,
            "translation": "text of %d characters" % len(prompt), "original_language": "unknown",
            "risk_signals": [], "is_silent_churn": len(prompt) % 2 == 0, "confidence": 0.5,
            "high_risk_accounts": [], "portfolio_themes": ["themes"], "urgent_actions": [],
        }
        return "```json\n" + json.dumps(answer) + "\n```"
    return client


def enrich_notes(i: Inputs) -> DataFrame:
    facts = enrich.model_note_intelligence(i.known_notes, i.accounts, stub_client, i.cfg)
    return facts.select(
        "account_id", "sentiment", _joined("competitors"), _joined("risk_factors", "; "),
        "executive_involved", "budget_concern", "renewal_signal", "champion_status", "missed_qbrs",
    )


def enrich_notes_fallback(i: Inputs) -> DataFrame:
    facts = enrich.model_note_intelligence(i.known_notes, i.accounts, None, i.cfg)
    return facts.select(
        "account_id", "sentiment", _joined("competitors"), _joined("risk_factors", "; "),
        "executive_involved", "budget_concern", "renewal_signal", "champion_status",
        "missed_qbrs", "note_count",
    )


def translate_comments(i: Inputs) -> DataFrame:
    return enrich.translated_comments(i.nps, None).select(
        "account_id", "ord", "translation", "original_language", "sentiment"
    )


def notes_overview(i: Inputs) -> DataFrame:
    parts = enrich.notes_overview(i.known_notes, standins.overview_client, i.cfg)
    names = F.transform("high_risk_accounts", lambda a: a["account_name"])
    return parts.select(
        "part", "first_account_id", "notes", "answered", F.array_join(names, "; ").alias("high_risk_accounts"),
        _joined("portfolio_themes"), _joined("urgent_actions"),
    )


def _store(i: Inputs, name: str) -> ReplyStore:
    return ReplyStore(i.spark, f"{shared_folder(i.spark)}/replies-{name}-{uuid.uuid4().hex}", "stand-in")


def enrich_notes_stored(i: Inputs) -> DataFrame:
    """Answers of a stand-in by a reply store; accounts without a valid one get the keywords' facts."""
    facts = enrich.model_note_intelligence(i.known_notes, i.accounts, standins.note_client, i.cfg, _store(i, "notes"))
    return facts.select(
        "account_id", "sentiment", _joined("competitors"), _joined("risk_factors", "; "), "executive_involved",
        "budget_concern", "renewal_signal", "champion_status", "missed_qbrs", "note_count",
    )


def translate_comments_stored(i: Inputs) -> DataFrame:
    """The second of two runs over one store: its client refuses to answer, so all comes from the store.
    ``asked`` is the number of prompts of the first run, ``asked_again`` of the second."""
    store = _store(i, "translations")
    enrich.translated_comments(i.nps, standins.translation_client, store)
    asked = store.asked
    again = enrich.translated_comments(i.nps, standins.no_client, store)
    return again.select(
        "account_id", "ord", "translation", "original_language", "sentiment",
        F.lit(asked).cast("bigint").alias("asked"), F.lit(store.asked - asked).cast("bigint").alias("asked_again"),
    )


def silent_churn_stored(i: Inputs) -> DataFrame:
    rows = enrich.silent_churn(details.with_summaries(i.scored), i.nps, standins.churn_client, _store(i, "churn"))
    return rows.select("account_id", "is_silent_churn", "confidence", "pattern_type", _joined("evidence"), "recommended_investigation")


def explanation_fallback(i: Inputs) -> DataFrame:
    return enrich.explanations(details.with_summaries(i.scored), None)


def silent_churn(i: Inputs) -> DataFrame:
    return enrich.silent_churn(details.with_summaries(i.scored), i.nps, None).select(
        "account_id", "is_silent_churn", "confidence", "pattern_type", _joined("evidence"),
        "recommended_investigation",
    )


def portfolio_fallback(i: Inputs) -> DataFrame:
    seen = _in_view(i)
    return enrich.portfolio_narrative(
        reports.portfolio_summary(seen), reports.top_high_risk(seen), None
    )


QUERIES = {
    "accounts_window": accounts_window,
    "usage_trend": usage_trend,
    "usage_mom": lambda i: usage.usage_mom(i.usage, i.cfg),
    "usage_risk": usage_risk,
    "usage_series": usage_series,
    "ticket_metrics": ticket_metrics,
    "ticket_risk": ticket_risk,
    "ticket_subjects": lambda i: tickets.subject_counts(i.tickets),
    "ticket_topics": lambda i: tickets.ticket_topics(i.tickets),
    "ticket_changelog_links": lambda i: tickets.ticket_event_links(i.tickets),
    "ticket_timeline": ticket_timeline,
    "nps_bands": nps_bands,
    "nps_contradiction": nps_contradiction,
    "nps_risk": nps_risk,
    "nps_histogram": lambda i: nps.nps_histogram(i.nps),
    "sdk_latest_distribution": lambda i: usage.latest_sdk_distribution(i.usage),
    "version_impacts": version_impacts,
    "event_impacts": lambda i: product.event_impacts(_latest_versions(i), i.cfg),
    "event_listing": lambda i: product.event_listing(_latest_versions(i), i.cfg),
    "product_risk": product_risk,
    "note_extract": note_extract,
    "note_intelligence": _note_intelligence,
    "note_signals": _note_signals,
    "reconcile_id": reconcile_id,
    "reconcile_fuzzy": reconcile_fuzzy,
    "account_scores": account_scores,
    "account_scores_window": account_scores_window,
    "account_scores_reconciled": account_scores_reconciled,
    "top_drivers": lambda i: reports.drivers_long(i.scored),
    "breakdown_long": lambda i: reports.breakdown_long(i.scored),
    "tier_counts": lambda i: reports.tier_totals(_in_view(i)).select("risk_tier", "accounts"),
    "arr_by_tier": lambda i: reports.tier_totals(_in_view(i)).select(
        "risk_tier", F.col("arr").cast("double").alias("arr")
    ),
    "tier_totals": lambda i: reports.tier_totals(i.scored).drop("ord").withColumns(_double("arr")),
    "kpis": lambda i: reports.kpis(_in_view(i)).withColumns(_double("arr_at_risk")),
    "portfolio_summary": lambda i: reports.portfolio_summary(_in_view(i)).withColumns(
        _double("high_risk_arr", "medium_risk_arr")
    ),
    "plan_tiers": lambda i: reports.plan_tiers(_in_view(i)),
    "view_counts": lambda i: reports.view_counts(i.scored, i.cfg),
    "risk_heatmap": lambda i: reports.heatmap(_in_view(i)),
    "top_high_risk": lambda i: reports.top_high_risk(i.scored).withColumns(_double("arr")),
    "risk_table": lambda i: reports.risk_table(_in_view(i)),
    "account_labels": lambda i: reports.account_labels(i.scored),
    "sdk_impact": lambda i: reports.sdk_impact(i.scored),
    "arr_deprecated": lambda i: reports.arr_deprecated(i.scored).withColumns(
        _double("arr_on_deprecated")
    ),
    "cohorts": lambda i: reports.cohorts(i.scored),
    "account_360": account_360,
    "account_page": account_page,
    "unresolved_tickets": unresolved_tickets,
    "filtered_view": filtered_view,
    "note_prompts": note_prompts,
    "tickets_lenient": tickets_lenient,
    "read_all_inputs": read_all_inputs,
    "account_detail": lambda i: details.account_headers(i.scored),
    "enrich_notes": enrich_notes,
    "enrich_notes_fallback": enrich_notes_fallback,
    "translate_comments": translate_comments,
    "notes_overview": notes_overview,
    "enrich_notes_stored": enrich_notes_stored,
    "translate_comments_stored": translate_comments_stored,
    "silent_churn_stored": silent_churn_stored,
    "explanation_fallback": explanation_fallback,
    "silent_churn": silent_churn,
    "portfolio_fallback": portfolio_fallback,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Inputs(spark, sf_dir))
