"""Readers for the input files. Everything stays lazy, but for the header lines.

CSV columns are found by header name. Files of one input may have their columns in different orders,
and may lack columns that have a default: files are grouped by header, each group is read by its own names, and
the groups are united by name. All columns are read as text and converted by the clean-up
step, so bad numbers become NULL where that is the rule and bad dates raise. ``read_lenient``
sets records that would raise aside instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.config import Config
from harborline.functions.order import with_file_order
from harborline.operators.clean import clean_accounts, clean_nps, clean_tickets, clean_usage
from harborline.operators.notes import extract_fields
from harborline.operators.product import events_table
from harborline.sources.headers import files_by_header
from harborline.sources.notes_text import read_note_records

# Field texts that mean "missing".
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class Input:
    """One kind of CSV input: columns that every file must have, what a file without one of the others
    means, and the types in which a bad value is an error."""

    required: tuple[str, ...]
    optional: dict[str, str | None]
    types: dict[str, str]


INPUTS = {
    "accounts": Input(
        ("account_id", "account_name", "plan_tier", "arr", "contract_end_date"),
        {"industry": None, "csm_name": None, "region": None},
        {"account_id": "bigint", "arr": "decimal(18,2)", "contract_end_date": "date"},
    ),
    "usage": Input(
        ("account_id", "month", "api_calls", "content_entries_created", "active_users", "workflows_triggered"),
        {"sdk_version": "unknown"}, {"account_id": "bigint", "month": "month"},
    ),
    "tickets": Input(
        ("account_id", "created_date", "priority", "status"),
        {"ticket_id": None, "resolution_time_hours": None, "subject": None, "description": None},
        {"account_id": "bigint", "created_date": "timestamp", "resolution_time_hours": "double"},
    ),
    "nps": Input(("account_id", "score"), {"verbatim_comment": None}, {"account_id": "bigint", "score": "double"}),
}
CORRUPT, FILE = "_corrupt_record", "_file"


def read_csv(
    spark: SparkSession, path, multi_line: bool = False, required: tuple[str, ...] = (),
    optional: dict[str, str | None] | None = None, whole: bool = False,
) -> DataFrame:
    """All columns as text, missing markers as NULL, plus the input position ``ord`` over all files.

    A file without one of the ``required`` columns raises. One without an ``optional`` column has
    its value in all rows; any other column that only some files have is NULL in the rest. Set
    ``multi_line`` only for files with line breaks inside quotes: such files cannot be split. With
    ``whole`` the file and, for records that don't fit the header, their text are columns too."""
    groups = files_by_header(spark, path)
    if not groups:
        raise ValueError(f"no file with a header: {path}")
    scans = []
    for names, files in groups.items():
        lacking = [c for c in required if c not in names]
        if lacking:
            raise ValueError(f"{files[0]} lacks {', '.join(lacking)}")
        reader = (
            spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
            .option("columnPruning", not whole).option("columnNameOfCorruptRecord", CORRUPT)
        )
        columns = [*names, CORRUPT] if whole else names
        raw = reader.schema(", ".join(f"`{c.replace('`', '``')}` string" for c in columns)).csv(files)
        added = {c: F.lit(value).cast("string") for c, value in (optional or {}).items() if c not in names}
        values = {c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) for c in names}
        scans.append(raw.withColumns(values | added) if values | added else raw)
    return with_file_order(scans, file=FILE if whole else None)


def _typed(kind: str, raw: DataFrame, cfg: Config) -> DataFrame:
    raw = raw.withColumn("account_id", F.col("account_id").cast("bigint"))
    if kind == "accounts":
        return clean_accounts(raw.withColumn("arr", F.col("arr").cast("decimal(18,2)")), cfg)
    if kind == "usage":
        return clean_usage(raw)
    if kind == "tickets":
        return clean_tickets(raw)
    return clean_nps(raw.withColumn("score", F.col("score").cast("double").cast("int")))


def _read(spark: SparkSession, kind: str, path, cfg: Config = Config(), **options) -> DataFrame:
    own = INPUTS[kind]
    return _typed(kind, read_csv(spark, path, required=own.required, optional=own.optional, **options), cfg)


def read_accounts(spark, path, cfg: Config = Config(), **options) -> DataFrame:
    return _read(spark, "accounts", path, cfg, **options)


def read_usage(spark, path, **options) -> DataFrame:
    return _read(spark, "usage", path, **options)


def read_tickets(spark, path, **options) -> DataFrame:
    return _read(spark, "tickets", path, **options)


def read_nps(spark, path, **options) -> DataFrame:
    return _read(spark, "nps", path, **options)


def _parsed(column: str, kind: str) -> Column:
    value = F.col(f"`{column}`")
    if kind == "month":
        return F.concat(value, F.lit("-01")).try_cast("date")
    return F.try_to_timestamp(value) if kind == "timestamp" else value.try_cast(kind)


def read_lenient(spark: SparkSession, kind: str, path, cfg: Config = Config(), multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of one kind of input without the records that the strict reader raises for, and those
    records: file, position, column, raw text and reason.

    A record is in exactly one of the two. A rejected one has a row for each bad field, or one without
    a column if it doesn't fit its file's header."""
    own = INPUTS[kind]
    raw = read_csv(spark, path, multi_line, own.required, own.optional, whole=True)
    malformed = F.col(CORRUPT).isNotNull()
    problems = [F.when(malformed, F.struct(
        F.lit(None).cast("string").alias("column"), F.col(CORRUPT).alias("raw_text"), F.lit("does not fit the header").alias("reason"),
    ))]
    for column, type_ in own.types.items():
        value = F.col(f"`{column}`")
        problems.append(F.when(~malformed & value.isNotNull() & _parsed(column, type_).isNull(), F.struct(
            F.lit(column).alias("column"), value.alias("raw_text"), F.lit(f"not a {type_.split('(')[0]}").alias("reason"),
        )))
    judged = raw.withColumn("_problems", F.filter(F.array(*problems), lambda x: x.isNotNull()))
    rejects = judged.select(F.col(FILE).alias("file"), F.col("ord").alias("position"), F.explode("_problems").alias("p"))
    good = judged.where(F.size("_problems") == 0)
    # Bad values are NULL in the kept plan too, so no cast raises whatever order filters run in.
    checked = {c: F.when(_parsed(c, t).isNotNull(), F.col(f"`{c}`")) for c, t in own.types.items()}
    rows = good.withColumns(checked).drop(CORRUPT, FILE, "_problems")
    return _typed(kind, rows, cfg), rejects.select("file", "position", "p.*")


def read_notes(spark, path, cfg: Config = Config()) -> DataFrame:
    return extract_fields(read_note_records(spark, path), cfg)


def read_changelog(spark, path) -> DataFrame:
    """The raw change log, one row per line with its position."""
    return with_file_order(spark.read.text(path)).withColumnRenamed("value", "line")


def read_all(spark, paths: dict, cfg: Config = Config()) -> dict[str, DataFrame]:
    """All inputs as lazy DataFrames; ``paths`` has the same keys as the result,
    the change log text being optional."""
    out = {
        "accounts": read_accounts(spark, paths["accounts"], cfg),
        "usage": read_usage(spark, paths["usage"]),
        "tickets": read_tickets(spark, paths["tickets"]),
        "nps": read_nps(spark, paths["nps"]),
        "csm_notes": read_notes(spark, paths["csm_notes"], cfg),
        "changelog_events": events_table(spark, cfg),
    }
    if "changelog" in paths:
        out["changelog"] = read_changelog(spark, paths["changelog"])
    return out
