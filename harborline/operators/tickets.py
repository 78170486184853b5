"""Support tickets: per-account counts, risks, topics and product-event links."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import TICKET_EVENT_LINKS, TICKET_TOPICS, Config
from harborline.functions.num import round_exact, round_product
from harborline.functions.text import any_of
from harborline.operators.clean import is_open

COUNTS = (
    "total_tickets", "recent_tickets", "older_tickets", "p1_count", "p2_count",
    "recent_p1_count", "open_count", "escalated_count", "recurring_count",
    "blocking_count", "linked_tickets",
)


def linked_event(subject: Column) -> Column:
    """Product event a ticket subject points to; NULL if none."""
    lowered = F.lower(subject)
    out = None
    for phrase, event in TICKET_EVENT_LINKS:
        hit = F.contains(lowered, F.lit(phrase))
        out = F.when(hit, event) if out is None else out.when(hit, event)
    return out


def _mentions(column: str, word: str) -> Column:
    return F.contains(F.lower(column), F.lit(word))


def ticket_summary(tickets: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per account with tickets: counts, mean hours and the two risks.
    Every aggregate is mergeable, so the shuffle carries partial rows only."""
    cutoff = F.lit(cfg.as_of - dt.timedelta(days=cfg.recent_ticket_days)).cast("timestamp")
    recent = F.col("created_date") >= cutoff
    p1 = F.col("priority") == "P1"
    df = tickets.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(recent).alias("recent_tickets"),
        F.count_if(F.col("created_date") < cutoff).alias("older_tickets"),
        F.count_if(p1).alias("p1_count"),
        F.count_if(F.col("priority") == "P2").alias("p2_count"),
        F.count_if(recent & p1).alias("recent_p1_count"),
        F.count_if(is_open()).alias("open_count"),
        F.count_if(F.col("status") == "Escalated").alias("escalated_count"),
        F.avg("resolution_time_hours").alias("_hours"),
        F.count_if(_mentions("description", "recurring")).alias("recurring_count"),
        F.count_if(_mentions("description", "blocking")).alias("blocking_count"),
        F.count_if(linked_event(F.col("subject")).isNotNull()).alias("linked_tickets"),
    )
    df = df.withColumns({
        "volume_change": volume_change(F.col("recent_tickets"), F.col("older_tickets")),
        "avg_resolution_hours": round_product(F.nullif(F.col("_hours"), F.lit(0.0)), 1),
        "p1_tickets": p1_risk(F.col("p1_count"), F.col("recent_p1_count")),
        "open_tickets": open_risk(F.col("open_count"), F.col("escalated_count")),
    })
    return df.drop("_hours")


def volume_change(recent: Column, older: Column) -> Column:
    ratio = F.try_divide((recent - older).cast("double"), older.cast("double"))
    fallback = F.when(recent == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(older > 0, round_exact(ratio, 3)).otherwise(fallback)


def _capped(count: Column, step: float, extra: Column, extra_step: float) -> Column:
    base = F.least(F.lit(1.0), count * F.lit(step))
    raised = F.least(F.lit(1.0), base + F.lit(extra_step) * extra)
    return round_product(F.when(extra > 0, raised).otherwise(base), 3)


def p1_risk(p1: Column, recent_p1: Column) -> Column:
    return _capped(p1, 0.3, recent_p1, 0.2)


def open_risk(open_count: Column, escalated: Column) -> Column:
    return _capped(open_count, 0.15, escalated, 0.1)


def subject_counts(tickets: DataFrame) -> DataFrame:
    """Tickets per account and subject, in long form; missing subjects are skipped."""
    return (
        tickets.where(F.col("subject").isNotNull())
        .groupBy("account_id", "subject")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )


def ticket_topics(tickets: DataFrame) -> DataFrame:
    """One row per ticket and topic; a ticket may carry several topics."""
    words = F.lower(
        F.concat(
            F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))
        )
    )
    flags = [
        F.when(any_of([F.contains(words, F.lit(p)) for p in phrases]), F.lit(topic))
        for topic, phrases in TICKET_TOPICS
    ]
    found = F.array_compact(F.array(*flags))
    return tickets.select(
        "ticket_id", "account_id", F.explode(found).alias("event_type"),
        "subject", "priority", "status",
    )


def ticket_event_links(tickets: DataFrame) -> DataFrame:
    """Tickets whose subject points to a product event, one label each."""
    return tickets.select(
        "ticket_id", "account_id", "subject",
        linked_event(F.col("subject")).alias("changelog_event"), "priority", "status",
    ).where(F.col("changelog_event").isNotNull())


def ticket_timeline(tickets: DataFrame) -> DataFrame:
    """P1 to P4 tickets for the timeline, with marker and colour classes."""
    priority = F.col("priority")
    return tickets.where(priority.isin("P1", "P2", "P3", "P4")).select(
        "account_id", "ticket_id", "created_date", "priority", "subject",
        F.when(F.col("status") == "Resolved", "circle").otherwise("x").alias("marker"),
        F.when(priority == "P1", "danger").when(priority == "P2", "warning")
        .when(priority == "P3", "info").otherwise("muted").alias("display_class"),
    )
