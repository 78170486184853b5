"""Optional text-model enrichment, run inside Spark tasks.

The caller passes a client factory: a picklable function without arguments that
returns ``client(prompt) -> reply text``, or None if no model is available. Each
task builds one client. Spark may run a task again, so a client must tolerate
repeated prompts. Rows whose model call fails, or that have no client, get the
deterministic fallback; no row is lost. With a ``ReplyStore`` every distinct prompt is asked once over all
runs; without one each row is asked when it is read.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import Config
from harborline.functions.num import fixed_text, money_text
from harborline.functions.running import parts_of, with_running_total
from harborline.operators import prompts as p
from harborline.operators.nps import with_comments
from harborline.operators.notes import INTELLIGENCE, note_intelligence
from harborline.operators.replies import ReplyStore

Client = Callable[[str], str]
ATTEMPTS = 3
#: Bytes of prompts whose answers a Python worker holds at a time.
SLICE_BYTES = 4 * 1024 * 1024

INTELLIGENCE_SCHEMA = (
    "sentiment string, competitors array<string>, risk_factors array<string>, "
    "executive_involved boolean, budget_concern boolean, renewal_signal string, "
    "champion_status string, missed_qbrs bigint, action_items array<string>, key_quote string"
)
TRANSLATION_SCHEMA = (
    "translation string, original_language string, sentiment string, risk_signals array<string>"
)
OVERVIEW_LISTS = {
    "high_risk_accounts": "array<struct<account_name string, risk_level string, "
    "key_risks array<string>, competitors_mentioned array<string>, executive_involved boolean>>",
    "portfolio_themes": "array<string>", "urgent_actions": "array<string>",
}
OVERVIEW_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in OVERVIEW_LISTS.items())
SILENT_CHURN_SCHEMA = (
    "is_silent_churn boolean, confidence double, pattern_type string, evidence array<string>, "
    "counter_evidence array<string>, recommended_investigation string"
)


def without_fence(text: str) -> str:
    """Drops the first and last line of a reply wrapped in a code fence."""
    text = text.strip()
    return "\n".join(text.split("\n")[1:-1]) if text.startswith("```") else text


def ask(client: Client | None, prompt: str, as_json: bool, sleep=time.sleep) -> str | None:
    """The reply, or None. Malformed JSON is asked again at once; other errors
    wait one second, then two; the third failure gives up."""
    if client is None:
        return None
    for attempt in range(ATTEMPTS):
        try:
            reply = client(prompt)
            if not as_json:
                return reply
            reply = without_fence(reply)
            try:
                json.loads(reply)
                return reply
            except json.JSONDecodeError:
                continue
        except Exception:  # any client error counts as a failed attempt
            if attempt < ATTEMPTS - 1:
                sleep(2**attempt)
    return None


def with_replies(
    df: DataFrame, prompt: Column, factory: Callable[[], Client | None] | None, as_json: bool = True,
    store: ReplyStore | None = None, carried: list[str] | None = None,
) -> DataFrame:
    """Adds ``reply`` (NULL where no valid answer came). Without a store rows keep their partition,
    and without a factory too there is no Python stage. Prompts become Python texts a few megabytes at a
    time, whatever Spark sends at once, and only the ``carried`` columns (default: all) go with them."""
    others = df.columns if carried is None else carried
    if store is not None:
        return store.answered(df, prompt, factory, ask, as_json).select(*others, "reply")
    if factory is None:
        return df.select(*others, F.lit(None).cast("string").alias("reply"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        for batch in batches:
            for part in _slices(batch, len(others)):
                # One text at a time: a prompt may be long.
                replies = [ask(client, text.as_py(), as_json) for text in part.column(len(others))]
                columns = [part.column(i) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(replies, pa.string())], names=[*others, "reply"])

    rows = df.select(*others, prompt.alias("_prompt"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{keys}, reply string")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``SLICE_BYTES`` of the column, or of one row."""
    sizes = [v.as_buffer().size if v.is_valid else 0 for v in batch.column(column)]
    start = size = 0
    for i, own in enumerate(sizes):
        if i > start and size + own > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start = i
            size = 0
        size += own
    if start < batch.num_rows:
        yield batch.slice(start)


def _parsed(schema: str) -> Column:
    return F.from_json("reply", schema)


# --- call notes -------------------------------------------------------------


#: Between two notes of one prompt.
BETWEEN = "\n\n"


def packed_texts(notes: DataFrame, limit: int, by_account: bool) -> DataFrame:
    """Notes joined by blank lines, in the order of account and input, in parts of at most ``limit``
    characters. Each note is in exactly one part, whole; only a single note exceeds the limit.

    The parts of each account, or (``account_id`` is then the part's first) of all notes together.
    They follow from running totals over the order alone, so any partitioning gives the same parts."""
    matched = notes.where(F.col("raw_text").isNotNull()).select(F.col("matched_account_id").alias("account_id"), "ord", "raw_text")
    size = (F.length("raw_text") + len(BETWEEN)).cast("bigint")
    narrow = matched.select("account_id", "ord", size.alias("size"))
    placed = with_running_total(narrow, ["account_id", "ord"], F.col("size"), "start")
    if by_account:
        first = placed.groupBy("account_id").agg(F.min("start").alias("first"))
        placed = placed.join(first, "account_id").withColumn("start", F.col("start") - F.col("first"))
    placed = placed.select("ord", parts_of(F.col("start"), F.col("size"), limit).alias("part"))
    keys = ["account_id", "part"] if by_account else ["part"]
    ordered = F.array_sort(F.collect_list(F.struct("account_id", "ord", "raw_text")))
    return matched.join(placed, "ord").groupBy(*keys).agg(
        *([] if by_account else [F.min("account_id").alias("account_id")]),
        F.array_join(F.transform(ordered, lambda n: n["raw_text"]), BETWEEN).alias("note_text"),
        F.count(F.lit(1)).alias("note_count"), F.min("ord").alias("first_ord"),
    )


def account_texts(notes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Each account's notes in parts of at most ``prompt_characters`` (see ``packed_texts``)."""
    return packed_texts(notes.where(F.col("matched_account_id").isNotNull()), cfg.prompt_characters, by_account=True)


def note_prompt() -> Column:
    """The prompt of a row of ``account_texts`` with its account's columns."""
    return p.fill(
        p.NOTE_TASK, account_name=F.col("account_name"), account_id=F.col("account_id"),
        plan_tier=F.col("plan_tier"), arr=money_text(F.col("arr")),
        contract_end=F.col("contract_end_date"), note_text=F.col("note_text"),
    )


def model_note_intelligence(
    notes: DataFrame, accounts: DataFrame, factory, cfg: Config = Config(),
    store: ReplyStore | None = None,
) -> DataFrame:
    """One row per account in the shape of ``note_intelligence``, from a text model
    where it answers and from keywords where it does not.

    An account in several parts is the model's only if every part was answered; otherwise, and
    without a factory, it is ``note_intelligence`` over all its notes, whatever the parts' size."""
    keyword = note_intelligence(notes).join(accounts.select("account_id").distinct(), "account_id", "left_semi")
    if factory is None and store is None:
        return keyword
    texts = account_texts(notes, cfg).join(
        accounts.select("account_id", "account_name", "plan_tier", "arr", "contract_end_date"),
        "account_id",
    )
    prompt = note_prompt()
    keys = ["account_id", "part", "note_count", "first_ord"]
    asked = with_replies(texts.select(*keys, prompt.alias("_text")), F.col("_text"), factory, store=store)
    answered = asked.withColumn("m", _parsed(INTELLIGENCE_SCHEMA))
    empty = F.array().cast("array<string>")
    defaults = {
        "sentiment": F.lit("neutral"), "competitors": empty, "risk_factors": empty,
        "executive_involved": F.lit(False), "budget_concern": F.lit(False),
        "renewal_signal": F.lit("neutral"), "champion_status": F.lit("unknown"),
        "missed_qbrs": F.lit(0).cast("bigint"), "action_items": empty, "key_quote": F.lit(""),
    }
    per_part = answered.select(*keys, F.col("m").isNull().alias("failed"), *[
        F.coalesce(F.col(f"m.{n}"), defaults[n]).alias(n) for n in INTELLIGENCE
    ])
    merged = _merge_parts(per_part)
    failed = merged.where("failed").select("account_id")
    keyword = keyword.join(failed, "account_id", "left_semi")
    return merged.where(~F.col("failed")).select(*keyword.columns).unionByName(keyword)


def _merge_parts(per_part: DataFrame) -> DataFrame:
    """Parts to accounts by rules that leave a single part as it is, but for repeated list
    entries: lists unite in the order of the notes, counts add up, the first quote stays."""
    def any_status(column: str, value: str) -> Column:
        return F.bool_or(F.col(column) == value)

    lists = ("competitors", "risk_factors", "action_items")
    merged = per_part.groupBy("account_id").agg(
        F.sum("note_count").alias("note_count"), F.bool_or("failed").alias("failed"),
        F.bool_or("executive_involved").alias("executive_involved"),
        F.bool_or("budget_concern").alias("budget_concern"),
        F.sum("missed_qbrs").alias("missed_qbrs"),
        F.when(any_status("champion_status", "lost"), "lost")
        .when(any_status("champion_status", "at_risk"), "at_risk")
        .when(any_status("champion_status", "active"), "active").otherwise("unknown")
        .alias("champion_status"),
        F.when(any_status("sentiment", "mixed") | (any_status("sentiment", "negative") & any_status("sentiment", "positive")), "mixed")
        .when(any_status("sentiment", "negative"), "negative").when(any_status("sentiment", "positive"), "positive")
        .otherwise("neutral").alias("sentiment"),
        F.when(any_status("renewal_signal", "negative"), "negative").when(any_status("renewal_signal", "mixed"), "mixed")
        .when(any_status("renewal_signal", "positive"), "positive").otherwise("neutral").alias("renewal_signal"),
        F.array_sort(F.collect_list(F.struct("first_ord", *lists, "key_quote"))).alias("_parts"),
    )
    return merged.withColumns({
        name: F.array_distinct(F.flatten(F.col("_parts").getField(name))) for name in lists
    }).withColumn("key_quote", F.col("_parts")[0]["key_quote"]).drop("_parts")


def notes_overview(notes: DataFrame, factory, cfg: Config = Config(), store: ReplyStore | None = None) -> DataFrame:
    """Portfolio-wide findings: one row for each part of at most ``prompt_characters`` of all notes
    (see ``packed_texts``), with empty lists where no answer came."""
    parts = packed_texts(notes, cfg.prompt_characters, by_account=False)
    keys = ["part", F.col("account_id").alias("first_account_id"), F.col("note_count").alias("notes")]
    rows = parts.select(*keys, p.fill(p.NOTES_OVERVIEW_TASK, notes=F.col("note_text")).alias("_text"))
    asked = with_replies(rows, F.col("_text"), factory, store=store, carried=["part", "first_account_id", "notes"])
    asked = asked.withColumn("m", _parsed(OVERVIEW_SCHEMA))
    return asked.select(
        "part", "first_account_id", "notes", F.col("m").isNotNull().alias("answered"),
        *(F.coalesce(f"m.{name}", F.from_json(F.lit("[]"), kind)).alias(name) for name, kind in OVERVIEW_LISTS.items()),
    )


# --- survey comments --------------------------------------------------------


def translated_comments(nps: DataFrame, factory, store: ReplyStore | None = None) -> DataFrame:
    """Translations of the comments that are not English; without an answer the
    comment itself with unknown language and sentiment."""
    foreign = nps.where("is_non_english").select("account_id", "ord", "verbatim_comment")
    prompt = p.fill(p.TRANSLATION_TASK, comment=F.col("verbatim_comment"))
    m = _parsed(TRANSLATION_SCHEMA)
    unknown = F.lit("unknown")
    return with_replies(foreign, prompt, factory, store=store).withColumn("m", m).select(
        "account_id", "ord",
        F.coalesce("m.translation", "verbatim_comment").alias("translation"),
        F.coalesce("m.original_language", unknown).alias("original_language"),
        F.coalesce("m.sentiment", unknown).alias("sentiment"),
        F.coalesce("m.risk_signals", F.array().cast("array<string>")).alias("risk_signals"),
    )


# --- accounts and portfolio -------------------------------------------------


def explanation_text() -> Column:
    return p.fill(p.EXPLANATION_TEXT, **p.account_values())


def explanations(summarised: DataFrame, factory, store: ReplyStore | None = None) -> DataFrame:
    """A written explanation per account (see ``details.with_summaries``)."""
    rows = summarised.select(
        "account_id", explanation_text().alias("_plain"),
        p.fill(p.EXPLANATION_TASK, **p.account_values()).alias("_task"),
    )
    asked = with_replies(rows, F.col("_task"), factory, as_json=False, store=store)
    return asked.select("account_id", F.coalesce("reply", "_plain").alias("explanation"))


def _percent(column: str) -> Column:
    value = F.coalesce(F.col(column), F.lit(0.0))
    return F.when(value == 0, "0").otherwise(fixed_text(value * F.lit(100), 1))


def silent_churn(summarised: DataFrame, nps: DataFrame, factory, store: ReplyStore | None = None) -> DataFrame:
    """Silent-churn assessment per account, with a constant fallback."""
    summarised = with_comments(summarised, nps)
    prompt = p.fill(
        p.SILENT_CHURN_TASK, account_name=F.col("account_name"),
        nps_score=F.coalesce(F.col("nps_score").cast("string"), F.lit("N/A")),
        nps_comment=F.when(F.col("comment") != "", F.col("comment")).otherwise("No comment provided"),
        api_trend=_percent("api_calls_change"), user_trend=_percent("active_users_change"),
        content_trend=_percent("content_entries_change"),
        csm_intelligence=F.col("csm_intelligence"),
    )
    rows = summarised.select("account_id", prompt.alias("_task"))
    fallback = F.from_json(F.lit(json.dumps(p.SILENT_CHURN_FALLBACK)), SILENT_CHURN_SCHEMA)
    asked = with_replies(rows, F.col("_task"), factory, store=store)
    return asked.select("account_id", F.coalesce(_parsed(SILENT_CHURN_SCHEMA), fallback).alias("m")).select(
        "account_id", "m.*"
    )


def account_lines(top_accounts: DataFrame) -> Column:
    """One text line per account of a top list, joined in rank order (aggregate)."""
    line = F.concat(
        F.lit("- "), "account_name", F.lit(": Score "), fixed_text(F.col("risk_score"), 3),
        F.lit(", ARR $"), F.format_number("arr", 2), F.lit(", "), "plan_tier",
    )
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("risk_score"), "account_id", line.alias("line"))))
    return F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")


def portfolio_narrative(
    summary: DataFrame, top_accounts: DataFrame, factory, signals: str = "", events: str = "",
    store: ReplyStore | None = None,
) -> DataFrame:
    """One row: the portfolio text. ``top_accounts`` is the ten-row top list."""
    lines = top_accounts.agg(account_lines(top_accounts).alias("top_risk_accounts"))
    values = p.portfolio_values()
    rows = summary.withColumn("top_risk_accounts", lines.scalar()).select(
        p.fill(p.PORTFOLIO_TEXT, **values).alias("_plain"),
        p.fill(
            p.PORTFOLIO_TASK, **values, top_risk_accounts=F.col("top_risk_accounts"),
            portfolio_signals=F.lit(signals), product_risk_events=F.lit(events),
        ).alias("_task"),
    )
    asked = with_replies(rows, F.col("_task"), factory, as_json=False, store=store)
    return asked.select(F.coalesce("reply", "_plain").alias("narrative"))
