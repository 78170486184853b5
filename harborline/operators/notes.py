"""Call notes: header fields out of free text, and signals from keywords.

The keyword signals of an account are defined on the text of all its notes
joined by blank lines. No keyword contains a line break, so "occurs in the joined
text" equals "occurs in some note" and occurrence counts add up. They are
therefore computed per note and merged with OR / sum: texts are never shuffled
or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline import config as c
from harborline.config import Config
from harborline.functions.text import (
    contains_any_sql,
    first_group,
    occurrences_sql,
    quote,
    strip,
)

# Java switches: line end is '\n' only, white space and word edges are Unicode.
_UNICODE = "(?dU)"
_UNICODE_ANY_CASE = "(?diuU)"


def account_id_in(text: Column) -> Column:
    found = [first_group(text, _UNICODE_ANY_CASE + p) for p in c.ACCOUNT_ID_PATTERNS]
    return F.coalesce(*found).try_cast("bigint")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def account_name_in(text: Column) -> Column:
    line = strip(first_line(text))
    group = {
        name: strip(first_group(line, _UNICODE + pattern))
        for name, pattern in (
            ("pipe", c.NAME_PIPE_PATTERN), ("talked", c.NAME_TALKED_PATTERN),
            ("dash", c.NAME_DASH_PATTERN), ("date", c.NAME_DATE_PATTERN),
        )
    }
    dash_ok = ~F.lower(group["dash"]).isin(*c.NAME_DASH_STOP)
    date_ok = ~F.lower(group["date"]).isin(*c.NAME_DATE_STOP) & (F.length(group["date"]) > 3)
    return F.coalesce(
        group["pipe"], group["talked"],
        F.when(dash_ok, group["dash"]), F.when(date_ok, group["date"]),
    )


def date_text_in(text: Column) -> Column:
    line = first_line(text)
    words = _UNICODE + c.DATE_WORD_PATTERN
    return F.coalesce(
        first_group(line, _UNICODE + c.DATE_ISO_PATTERN),
        first_group(line, _UNICODE + c.DATE_SLASH_PATTERN),
        F.concat(first_group(line, words, 1), F.lit(" "), first_group(line, words, 2)),
    )


def owner_in(text: Column, owners=c.OWNERS) -> Column:
    lowered = F.lower(text)
    by_name, by_first = [], {}
    for owner in owners:
        first, last = owner.split()[:2]
        short = f"{first} {last[0]}.".lower()
        hit = F.contains(lowered, F.lit(owner.lower())) | F.contains(lowered, F.lit(short))
        by_name.append(F.when(hit, F.lit(owner)))
        by_first[first.lower()] = owner
    alone = [
        F.when(F.rlike(text, F.lit(rf"(?iuU)\b{first}\b")), F.lit(owner))
        for first, owner in by_first.items()
    ]
    any_first = F.rlike(text, F.lit(rf"(?iuU)\b(?:{'|'.join(by_first)})\b"))
    return F.coalesce(*by_name, F.when(any_first, F.coalesce(*alone)))


def extract_fields(records: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds account id, raw account name, raw date text and owner to ``raw_text``."""
    text = F.col("raw_text")
    return records.withColumns({
        "account_id": account_id_in(text),
        "account_name_raw": account_name_in(text),
        "date_raw": date_text_in(text),
        "csm_name": owner_in(text, cfg.owners),
    })


# --- keyword signals --------------------------------------------------------

_FLAGS = {
    "executive_involved": c.EXECUTIVE_WORDS,
    "budget_concern": c.BUDGET_WORDS,
    "no_show": c.NO_SHOW_WORDS,
    "churn_language": c.CHURN_WORDS,
    "migration": c.MIGRATION_WORDS,
    "downgrade": c.DOWNGRADE_WORDS,
    "merger": c.MERGER_WORDS,
    "renewal_negative": c.RENEWAL_NEGATIVE,
    "renewal_positive": c.RENEWAL_POSITIVE,
    "champion_talk": c.CHAMPION_WORDS,
    "champion_risk": c.CHAMPION_RISK_WORDS,
}
# One bit per word, so that OR-ing notes counts distinct words of an account.
_WORD_SETS = {
    "competitor_bits": tuple(word for word, _ in c.COMPETITORS),
    "negative_bits": c.NOTE_NEGATIVE,
    "positive_bits": c.NOTE_POSITIVE,
}


def _bits(text: str, words) -> str:
    return " + ".join(
        f"if(contains({text}, {quote(word)}), {1 << i}, 0)" for i, word in enumerate(words)
    )


def note_marks(text: str) -> list[Column]:
    """Mergeable marks of one note; ``text`` is its lower-cased, non-null column."""
    marks = {name: contains_any_sql(text, words) for name, words in _FLAGS.items()}
    marks |= {name: _bits(text, words) for name, words in _WORD_SETS.items()}
    missed = " + ".join(occurrences_sql(text, phrase) for phrase in c.MISSED_QBR_PHRASES)
    return [F.expr(sql).alias(name) for name, sql in (marks | {"missed_qbrs": missed}).items()]


def with_lowered(notes: DataFrame, column: str) -> DataFrame:
    return notes.withColumn("_text", F.lower(F.coalesce(F.col(column), F.lit(""))))


def _mark_aggregates() -> list[Column]:
    out = [F.bool_or(name).alias(name) for name in _FLAGS]
    out += [F.bit_or(name).alias(name) for name in _WORD_SETS]
    return out + [F.sum("missed_qbrs").alias("missed_qbrs"), F.count(F.lit(1)).alias("note_count")]


def competitor_names(bits: Column) -> Column:
    names = [
        F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name))
        for i, (_, name) in enumerate(c.COMPETITORS)
    ]
    return F.array_compact(F.array(*names))


def sentiment(negative: Column, positive: Column) -> Column:
    return (
        F.when(negative > positive, "negative").when(positive > negative, "positive")
        .when(negative > 0, "mixed").otherwise("neutral")
    )


def risk_factors() -> Column:
    listed = F.array_join("competitors", ", ")
    entries = [
        F.when(F.size("competitors") > 0, F.concat(F.lit("Competitor evaluation: "), listed)),
        F.when(F.col("executive_involved"), "Executive involvement detected"),
        F.when(F.col("budget_concern"), "Budget/pricing concerns raised"),
        F.when(F.col("no_show"), "Missed meeting/QBR"),
        F.when(F.col("churn_language"), "Churn/cancellation language detected"),
        F.when(F.col("migration"), "Migration activity detected"),
        F.when(F.col("downgrade"), "Downgrade discussion"),
        F.when(F.col("merger"), "M&A activity"),
    ]
    return F.array_compact(F.array(*entries))


def _interpret(marks: DataFrame) -> DataFrame:
    df = marks.withColumn("competitors", competitor_names(F.col("competitor_bits")))
    df = df.withColumn("risk_factors", risk_factors())
    return df.withColumns({
        "sentiment": sentiment(F.bit_count("negative_bits"), F.bit_count("positive_bits")),
        "renewal_signal": F.when(F.col("renewal_negative"), "negative")
        .when(F.col("renewal_positive"), "positive")
        .when((F.size("competitors") > 0) | F.col("budget_concern"), "mixed")
        .otherwise("neutral"),
        "champion_status": F.when(
            F.col("champion_talk"), F.when(F.col("champion_risk"), "at_risk").otherwise("active")
        ).otherwise("unknown"),
        "action_items": F.array().cast("array<string>"),
        "key_quote": F.lit(""),
    })


INTELLIGENCE = [
    "sentiment", "competitors", "risk_factors", "executive_involved", "budget_concern",
    "renewal_signal", "champion_status", "missed_qbrs", "action_items", "key_quote",
]


def text_intelligence(texts: DataFrame, text_column: str, keys: list[str]) -> DataFrame:
    """Keyword intelligence of each text on its own."""
    marked = with_lowered(texts, text_column).select(*keys, *note_marks("_text"))
    return _interpret(marked).select(*keys, *INTELLIGENCE)


def marked_notes(notes: DataFrame) -> DataFrame:
    """Notes with their keyword marks in place of their text, so that matching
    them to accounts moves a few numbers per note and not the text."""
    others = [name for name in notes.columns if name != "raw_text"]
    return with_lowered(notes, "raw_text").select(*others, *note_marks("_text"))


def note_intelligence(notes: DataFrame) -> DataFrame:
    """Keyword intelligence per account over all its notes (``matched_account_id``);
    takes notes with their text, or already marked."""
    if "missed_qbrs" not in notes.columns:
        notes = marked_notes(notes)
    known = notes.where(F.col("matched_account_id").isNotNull())
    merged = known.groupBy(F.col("matched_account_id").alias("account_id")).agg(*_mark_aggregates())
    return _interpret(merged).select("account_id", *INTELLIGENCE, "note_count")


def note_signals(intelligence: DataFrame) -> DataFrame:
    """The five note signals, plus the sentiment modifier, per account."""
    status = F.col("champion_status")
    tone = F.col("sentiment")
    return intelligence.withColumns({
        "competitor_mention": F.least(F.lit(1.0), F.size("competitors") * F.lit(0.5)),
        "executive_escalation": F.col("executive_involved").cast("double"),
        "budget_concern_risk": F.col("budget_concern").cast("double"),
        "champion_loss": F.when(status == "lost", F.lit(1.0))
        .when(status == "at_risk", F.lit(0.7)).otherwise(F.lit(0.0)),
        "missed_qbrs_risk": F.least(F.lit(1.0), F.col("missed_qbrs") * F.lit(0.4)),
        "sentiment_modifier": F.when(tone == "positive", F.lit(-0.1))
        .when(tone == "mixed", F.lit(0.2)).when(tone == "negative", F.lit(0.4))
        .otherwise(F.lit(0.0)),
    })
