"""Per-account views: the header with its summaries, and the child rows.

Child rows stay rows. Nothing gathers an account's history into one value, so an
account of any size can be written, filtered or counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.digest import sum_digest
from harborline.functions.num import fixed_text, money_text
from harborline.operators.tickets import ticket_timeline
from harborline.operators.usage import usage_series
from harborline.plans.reports import breakdown_long


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def list_text(items: Column) -> Column:
    """['a', 'b'] from an array of texts without quote marks."""
    quoted = F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def percent_text(share: Column) -> Column:
    return F.concat(fixed_text(share * F.lit(100), 1), F.lit("%"))


def with_summaries(scored: DataFrame) -> DataFrame:
    """Adds the five short texts that describe an account to a reader or a model."""
    def text(c) -> Column:
        return F.col(c).cast("string")

    return scored.withColumns({
        "usage_summary": F.concat(
            F.lit("Decline: "), "decline_severity", F.lit(", Change: "),
            percent_text(F.col("overall_change")),
        ),
        "ticket_summary": F.concat(
            F.lit("Total: "), text("total_tickets"), F.lit(", P1: "), text("p1_count"),
            F.lit(", Open: "), text("open_count"),
        ),
        "nps_summary": F.concat(
            F.lit("Score: "), F.coalesce(text("nps_score"), F.lit("None")),
            F.lit(", Category: "), "nps_category",
        ),
        "csm_intelligence": list_text(F.col("risk_factors")),
        "product_risk_summary": F.concat(
            F.lit("SDK: "), F.coalesce("trend_sdk", F.lit("nan")), F.lit(", Deprecated: "),
            _yes_no(F.col("is_deprecated_sdk")),
        ),
    })


def account_headers(scored: DataFrame) -> DataFrame:
    """One row per account: what the head of its detail page shows."""
    df = with_summaries(scored)
    return df.select(
        "account_id", "account_name", "risk_tier",
        fixed_text(F.col("risk_score"), 3).alias("score"), money_text(F.col("arr")).alias("arr"),
        "plan_tier", "days_to_renewal", "csm_name", "region",
        "decline_severity", percent_text(F.col("overall_change")).alias("overall_change"),
        F.col("trend_sdk").alias("sdk_version"),
        "total_tickets", "p1_count", "open_count", "recurring_count",
        "nps_score", "nps_category", "contradiction_detail",
        F.array_join("competitors", ", ").alias("competitors"), "note_count",
        "usage_summary", "ticket_summary", "nps_summary", "csm_intelligence",
        "product_risk_summary",
    )


def note_rows(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("matched_account_id").isNotNull()).select(
        F.col("matched_account_id").alias("account_id"), "ord", "match_method",
        "match_confidence", "raw_text",
    )


def account_detail(
    account_id: int, scored: DataFrame, usage: DataFrame, tickets: DataFrame, notes: DataFrame
) -> dict[str, DataFrame]:
    """Everything the detail page of one account shows, as lazy tables. The filter
    reaches the scans of stored tables."""
    mine = F.col("account_id") == account_id
    one = scored.where(mine)
    return {
        "header": account_headers(one),
        "breakdown": breakdown_long(one).orderBy(F.desc("contribution"), "ord"),
        "usage": usage_series(usage.where(mine)).orderBy("month_dt"),
        "tickets": ticket_timeline(tickets.where(mine)),
        "notes": note_rows(notes).where(mine).orderBy("ord"),
    }


def account_bundle(
    accounts: DataFrame, usage: DataFrame, tickets: DataFrame, nps: DataFrame, notes: DataFrame
) -> DataFrame:
    """All data of every account in long form: (account_id, section, ord, payload).

    ``payload`` is the source row as JSON. Rows of unknown accounts are left out;
    an account without child rows keeps its own ``account`` row."""
    known = accounts.select("account_id")
    notes_by_account = notes.withColumn("account_id", F.col("matched_account_id"))

    def section(df: DataFrame, name: str, order: Column) -> DataFrame:
        rows = df.select(
            "account_id", F.lit(name).alias("section"), order.cast("bigint").alias("ord"),
            F.to_json(F.struct(*[c for c in df.columns if c != "account_id"])).alias("payload"),
        )
        return rows if name == "account" else rows.join(known, "account_id", "left_semi")

    month = F.unix_date("month_dt")
    ticket_day = F.unix_seconds("created_date")
    parts = [
        section(accounts, "account", F.lit(0)),
        section(usage, "usage", month), section(tickets, "tickets", ticket_day),
        section(nps, "nps", F.col("ord")), section(notes_by_account, "notes", F.col("ord")),
    ]
    return reduce(DataFrame.unionByName, parts)


def bundle_digests(bundle: DataFrame, text: Column) -> DataFrame:
    """account_id, section, rows and an order-free digest of ``text`` over the rows of each account and
    section, for comparing bundles without moving them."""
    return bundle.groupBy("account_id", "section").agg(F.count(F.lit(1)).alias("rows"), sum_digest(text).alias("digest"))
