"""Survey answers: latest answer, contradiction with the comment, and risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import NPS_NEGATIVE, NPS_POSITIVE
from harborline.functions.text import contains_any
from harborline.operators.clean import nps_band

NO_ANSWER_DETRACTOR = 0.3
NO_ANSWER_DETERIORATION = 0.2
HIGH_BUT_NEGATIVE = "positive_score_negative_comment"
LOW_BUT_POSITIVE = "negative_score_positive_comment"


def contradiction_type(score: Column, comment: Column) -> Column:
    lowered = F.lower(comment)
    return F.when(
        (score >= 7) & contains_any(lowered, NPS_NEGATIVE), HIGH_BUT_NEGATIVE
    ).when((score <= 4) & contains_any(lowered, NPS_POSITIVE), LOW_BUT_POSITIVE)


def contradiction_detail(score: Column, kind: Column) -> Column:
    text = score.cast("string")
    return F.when(
        kind == HIGH_BUT_NEGATIVE,
        F.concat(F.lit("NPS "), text, F.lit(" (Passive/Promoter) but comment contains risk signals")),
    ).when(
        kind == LOW_BUT_POSITIVE,
        F.concat(
            F.lit("NPS "), text,
            F.lit(" (Detractor) but comment is positive — possible misclick or survey fatigue"),
        ),
    )


def detractor_risk(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(NO_ANSWER_DETRACTOR))
        .when(score <= 4, F.lit(1.0)).when(score <= 6, F.lit(0.7))
        .when(score <= 7, F.lit(0.3)).when(score <= 8, F.lit(0.1)).otherwise(F.lit(0.0))
    )


def deterioration_risk(score: Column, kind: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(NO_ANSWER_DETERIORATION))
        .when(kind == HIGH_BUT_NEGATIVE, F.lit(0.8))
        .when(kind == LOW_BUT_POSITIVE, F.lit(0.3)).otherwise(F.lit(0.0))
    )


def nps_summary(nps: DataFrame) -> DataFrame:
    """The last answer of each account (by ``ord``) and what follows from it.
    An answer without a score counts as no answer.

    Score and flags travel as one number, so the aggregate keeps two numbers per
    account in a hash table and no comment text is sorted or shuffled."""
    score, comment = F.col("score"), F.col("verbatim_comment")
    kind = contradiction_type(score, comment)
    answer = (
        score.cast("bigint") * 16
        + F.col("is_non_english").cast("bigint") + (comment != "").cast("bigint") * 2
        + F.when(kind == HIGH_BUT_NEGATIVE, 4).when(kind == LOW_BUT_POSITIVE, 8).otherwise(0)
    )
    answered = nps.where(score.isNotNull()).select("account_id", "ord", answer.alias("answer"))
    last = answered.groupBy("account_id").agg(
        F.max("ord").alias("nps_ord"), F.max_by("answer", "ord").alias("answer")
    )

    def flag(bit: int) -> Column:
        return F.col("answer").bitwiseAND(F.lit(bit)) != 0

    df = last.select(
        "account_id", "nps_ord", F.shiftright("answer", 4).cast("int").alias("score"),
        flag(1).alias("is_non_english"), flag(2).alias("has_comment"),
        F.when(flag(4), HIGH_BUT_NEGATIVE).when(flag(8), LOW_BUT_POSITIVE).alias("contradiction_type"),
    )
    score, kind = F.col("score"), F.col("contradiction_type")
    return df.withColumns({
        "nps_category": F.coalesce(nps_band(score), F.lit("nan")),
        "contradiction_detected": kind.isNotNull(),
        "contradiction_detail": contradiction_detail(score, kind),
        "nps_detractor": detractor_risk(score),
        "nps_deterioration": deterioration_risk(score, kind),
    })


def with_comments(scored: DataFrame, nps: DataFrame) -> DataFrame:
    """Adds the text of each account's last answer, '' without one."""
    texts = nps.select(
        "account_id", F.col("ord").alias("nps_ord"), F.col("verbatim_comment").alias("comment")
    )
    joined = scored.join(texts, ["account_id", "nps_ord"], "left")
    return joined.withColumn("comment", F.coalesce("comment", F.lit("")))


def nps_histogram(nps: DataFrame) -> DataFrame:
    """Answers per score 0..10, zero-filled, with the band's display class."""
    spark = nps.sparkSession
    scores = spark.range(11).select(F.col("id").cast("int").alias("score"))
    counts = nps.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    score = F.col("score")
    return scores.join(counts, "score", "left").select(
        "score", F.coalesce("_n", F.lit(0)).alias("answers"),
        F.when(score <= 6, "danger").when(score <= 8, "warning").otherwise("success")
        .alias("display_class"),
    )
