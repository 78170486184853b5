"""Column clean-up of the four tabular inputs. No shuffle, no Python stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import FOREIGN_LETTERS, FOREIGN_SCRIPT, FOREIGN_WORDS, Config
from harborline.functions.num import nan_to_null, to_number
from harborline.functions.text import strip, whole_word

USAGE_METRICS = (
    "api_calls", "content_entries_created", "active_users", "workflows_triggered",
)


def in_window(days: Column, cfg: Config) -> Column:
    """Inclusive renewal window; an unknown date is outside."""
    return F.coalesce(days.between(cfg.window_from_days, cfg.window_to_days), F.lit(False))


def clean_accounts(raw: DataFrame, cfg: Config = Config()) -> DataFrame:
    texts = ("account_name", "plan_tier", "industry", "csm_name", "region")
    end = F.to_date("contract_end_date")
    df = raw.withColumns({c: strip(F.col(c)) for c in texts} | {"contract_end_date": end})
    df = df.withColumn("days_to_renewal", F.datediff("contract_end_date", F.lit(cfg.as_of)))
    return df.withColumn("in_renewal_window", in_window(F.col("days_to_renewal"), cfg))


def clean_usage(raw: DataFrame) -> DataFrame:
    """Adds ``month_dt``; metrics become numbers or NULL. An input without
    ``sdk_version`` gets the version 'unknown'. ``ord`` is the input position."""
    columns = {m: to_number(F.col(m)) for m in USAGE_METRICS}
    columns["month_dt"] = F.to_date(F.concat("month", F.lit("-01")))
    if "sdk_version" not in raw.columns:
        columns["sdk_version"] = F.lit("unknown")
    return raw.withColumns(columns)


def capitalise(text: Column) -> Column:
    """First letter upper, everything after it lower (not every word)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def clean_tickets(raw: DataFrame) -> DataFrame:
    status = capitalise(strip(F.col("status")))
    hours = nan_to_null(F.col("resolution_time_hours").cast("double"))
    df = raw.withColumns({
        "created_date": F.to_timestamp("created_date"),
        "priority": strip(F.upper("priority")),
        "status": status,
        "resolution_time_hours": hours,
    })
    return df.withColumn("is_unresolved", F.col("resolution_time_hours").isNull() | is_open())


def is_open() -> Column:
    return F.coalesce(F.col("status").isin("Open", "Escalated"), F.lit(False))


def nps_band(score: Column) -> Column:
    return (
        F.when((score > -1) & (score <= 6), F.lit("Detractor"))
        .when((score > 6) & (score <= 8), F.lit("Passive"))
        .when((score > 8) & (score <= 10), F.lit("Promoter"))
    )


def is_non_english(text: Column) -> Column:
    # Both cases are listed: a plain character class is far cheaper to scan for
    # than a case-insensitive one, and most foreign comments end there.
    letters = f"[{FOREIGN_SCRIPT}{FOREIGN_LETTERS}{FOREIGN_LETTERS.upper()}]"
    return F.rlike(text, F.lit(letters)) | F.rlike(text, F.lit(whole_word(FOREIGN_WORDS)))


def clean_nps(raw: DataFrame) -> DataFrame:
    df = raw.withColumn(
        "verbatim_comment", strip(F.coalesce(F.col("verbatim_comment"), F.lit("")))
    )
    return df.withColumns({
        "nps_category": nps_band(F.col("score")),
        "is_non_english": is_non_english(F.col("verbatim_comment")),
    })
