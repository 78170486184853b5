import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from harborline.config import SIGNALS, Config
from harborline.operators import enrich
from harborline.plans import details, reports
from harborline.plans.scoring import ranked, score_accounts, with_score
from tests.conftest import by_key
from workload.fixtures import Inputs

SF = "/root/testdata/sf0.001"
NAMES = [s for s, _, _ in SIGNALS]


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


@pytest.fixture(scope="module")
def scored(inputs):
    return inputs.scored.cache()


def signal_frame(spark, rows):
    return spark.createDataFrame(
        [(i, *[float(r.get(n, 0)) for n in NAMES]) for i, r in enumerate(rows)],
        "account_id int, " + ", ".join(f"{n} double" for n in NAMES))


def test_tier_bounds_and_order_of_drivers(spark):
    all_on = {n: 1 for n in NAMES}
    rows = [{}, all_on, {"usage_decline": 1, "p1_tickets": 1, "nps_detractor": 1},
            {"usage_decline": 1, "p1_tickets": 1, "nps_detractor": 0.999},
            {"nps_detractor": 1, "p1_tickets": 1, "missed_qbrs": 0.001}]
    got = by_key(with_score(signal_frame(spark, rows)))
    assert got[0].risk_tier == "Low" and got[0].risk_score == 0.0 and got[0].top_risk_drivers == []
    assert got[1].risk_score == pytest.approx(1.0) and got[1].risk_tier == "High" and len(got[1].top_risk_drivers) == 5
    assert got[2].risk_tier == "Medium" and got[2].risk_score == 0.4
    assert got[3].risk_tier == "Low" and got[3].risk_score == 0.3999
    # Equal contributions keep the signal order; a contribution that rounds to 0 is no driver.
    assert [d["signal"] for d in got[4].top_risk_drivers] == ["p1_tickets", "nps_detractor"]


def test_properties_of_scores(scored):
    for r in scored.collect():
        assert 0 <= r.risk_score <= 1 and all(0 <= r[n] <= 1 for n in NAMES)
        assert r.risk_score == pytest.approx(sum(d["contribution"] for d in r.score_breakdown), abs=1e-3)
        shown = [d["contribution"] for d in r.top_risk_drivers]
        assert shown == sorted(shown, reverse=True) and len(shown) <= 5


def test_window_only_is_a_filter_of_all(inputs, scored):
    part = score_accounts(inputs.accounts, inputs.usage, inputs.tickets, inputs.nps, inputs.known_notes)
    keep = ["account_id", "risk_score", "risk_tier"]
    want = reports.view(scored).select(*keep)
    assert sorted(part.select(*keep).collect()) == sorted(want.collect())


def test_defaults_without_any_facts(spark, inputs):
    none = [t.limit(0) for t in (inputs.usage, inputs.tickets, inputs.nps, inputs.known_notes)]
    r = score_accounts(inputs.accounts, *none, window_only=False).first()
    assert (r.nps_detractor, r.nps_deterioration, r.usage_decline, r.product_risk_impact) == (0.3, 0.2, 0.0, 0.0)
    assert r.risk_score == 0.04 and r.nps_category == "No Response" and r.decline_severity == "insufficient_data"
    assert r.current_sdk == r.trend_sdk == "unknown" and r.competitors == [] and r.sentiment == "unknown"


def test_product_risk_needs_usage(spark, inputs):
    """Linked tickets alone give no product risk."""
    r = score_accounts(inputs.accounts, inputs.usage.limit(0), inputs.tickets, inputs.nps, inputs.known_notes, window_only=False)
    assert r.agg(F.max("product_risk_impact"), F.max("linked_tickets")).first()[0] == 0.0


def test_views_and_reports(scored):
    assert reports.view(scored, show_all=True).count() == scored.count()
    assert set(r.risk_tier for r in reports.view(scored, show_all=True, tiers=["Low"]).collect()) == {"Low"}
    plans = [r.plan_tier for r in reports.plan_tiers(scored).collect()]
    assert plans == sorted(plans) and reports.view(scored, plans=plans[:1]).select("plan_tier").distinct().count() == 1
    empty = scored.limit(0)
    assert [(r.risk_tier, r.accounts, float(r.arr)) for r in reports.tier_totals(empty).collect()] == [
        ("High", 0, 0.0), ("Medium", 0, 0.0), ("Low", 0, 0.0)]
    assert reports.kpis(empty).first().avg_risk_score == 0.0
    top = ranked(scored).limit(20).collect()
    heat = reports.heatmap(scored).collect()
    assert [r.account_id for r in heat] == [r.account_id for r in top]
    assert reports.heatmap_long(scored).count() == 20 * 9
    breakdown = reports.breakdown_long(scored).where(F.col("account_id") == top[0].account_id)
    assert breakdown.where("contribution > 0.1 and display_class != 'danger'").count() == 0


def test_account_detail_and_bundle(inputs, scored):
    account = ranked(scored).first().account_id
    page = details.account_detail(account, scored, inputs.usage, inputs.tickets,
                                  inputs.known_notes.withColumns({"match_method": F.lit("id_direct"), "match_confidence": F.lit(100.0)}))
    assert page["header"].count() == 1 and page["notes"].count() >= 0
    assert page["tickets"].where(F.col("account_id") != account).count() == 0
    months = [r.month_dt for r in page["usage"].collect()]
    assert months == sorted(months)
    rows = details.account_bundle(inputs.accounts, inputs.usage, inputs.tickets, inputs.nps, inputs.known_notes)
    sections = {r.section for r in rows.select("section").distinct().collect()}
    assert sections == {"account", "usage", "tickets", "nps", "notes"}
    assert json.loads(rows.where("section = 'usage'").first().payload)["month"]


# --- enrichment --------------------------------------------------------------


def test_ask_retries():
    waits, calls = [], []

    def client(replies):
        queue = list(replies)

        def call(prompt):
            calls.append(prompt)
            reply = queue.pop(0)
            if isinstance(reply, Exception):
                raise reply
            return reply
        return call

    ok = '{"a": 1}'
    assert enrich.ask(client([ok]), "p", True, waits.append) == ok and waits == []
    assert enrich.ask(client(["no", "no", ok]), "p", True, waits.append) == ok and waits == []
    assert enrich.ask(client([OSError(), OSError(), ok]), "p", True, waits.append) == ok and waits == [1, 2]
    waits.clear()
    assert enrich.ask(client([OSError()] * 3), "p", True, waits.append) is None and waits == [1, 2]
    assert enrich.ask(client(["x", "y", "z"]), "p", True, waits.append) is None
    assert enrich.ask(client(["free text"]), "p", False) == "free text"
    assert enrich.ask(None, "p", True) is None
    assert enrich.ask(client(["```json\n" + ok + "\n```"]), "p", True) == ok


def always_json():
    def client(prompt):
        if "refuse" in prompt:
            return "not json"
        return json.dumps({"sentiment": "negative", "competitors": ["Rival"], "champion_status": "lost", "missed_qbrs": 2,
                           "translation": "T", "is_silent_churn": True, "evidence": ["e"], "portfolio_themes": ["t"]})
    return client


def text_client():
    return lambda prompt: "written"


def test_model_notes_merge_and_fall_back(spark):
    accounts = spark.createDataFrame([(1, "A", "Pro", dt.date(2026, 7, 1)), (2, "B", "Pro", dt.date(2026, 7, 1))],
                                     "account_id bigint, account_name string, plan_tier string, contract_end_date date"
                                     ).withColumn("arr", F.lit(5).cast("decimal(18,2)"))
    notes = spark.createDataFrame(
        [(1, i, f"note {i} " + "x" * 90) for i in range(50)] + [(2, 100, "refuse Strapi, budget"), (2, 101, "no show")],
        "matched_account_id bigint, ord bigint, raw_text string")
    cfg = Config(prompt_characters=1000)
    texts = enrich.account_texts(notes, cfg)
    assert texts.where("account_id = 1").count() > 2  # a long history goes out in parts
    assert texts.agg(F.sum("note_count")).first()[0] == 52
    assert texts.where("account_id = 2").first().note_text == "refuse Strapi, budget\n\nno show"
    got = by_key(enrich.model_note_intelligence(notes, accounts, always_json, cfg))
    assert got[1].competitors == ["Rival"] and got[1].champion_status == "lost" and got[1].note_count == 50
    assert got[2].competitors == ["Strapi"] and got[2].missed_qbrs == 1 and got[2].budget_concern


def test_other_enrichments(inputs, scored):
    told = details.with_summaries(scored)
    texts = [r.explanation for r in enrich.explanations(told, text_client).collect()]
    assert set(texts) == {"written"} and len(texts) == scored.count()
    assert enrich.silent_churn(told, inputs.nps, always_json).where("is_silent_churn").count() == scored.count()
    foreign = inputs.nps.where("is_non_english")
    translated = enrich.translated_comments(inputs.nps, always_json).collect()
    assert len(translated) == foreign.count() and {r.translation for r in translated} == {"T"}
    summary, top = reports.portfolio_summary(scored), reports.top_high_risk(scored)
    assert enrich.portfolio_narrative(summary, top, text_client).collect()[0].narrative == "written"
    overview = enrich.notes_overview(inputs.known_notes, always_json, Config(prompt_characters=3000))
    rows = overview.collect()
    assert sum(r.notes for r in rows) == inputs.known_notes.count() and rows[0].portfolio_themes == ["t"]


def test_model_facts_feed_the_score(inputs, scored):
    facts = enrich.model_note_intelligence(inputs.known_notes, inputs.accounts, always_json)
    again = score_accounts(inputs.accounts, inputs.usage, inputs.tickets, inputs.nps, inputs.known_notes,
                           window_only=False, note_facts=facts)
    assert again.where("champion_loss = 1.0").count() > 0
