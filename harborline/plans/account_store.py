"""Detail pages from stored tables: written once for all accounts, read for one by a point lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from harborline.config import Config
from harborline.operators.tickets import ticket_timeline
from harborline.operators.usage import usage_series
from harborline.plans.details import account_headers, note_rows
from harborline.plans.reports import breakdown_long
from harborline.sources.sinks import write_by_account

#: The tables of a detail page, each with the columns that order an account's rows.
SECTIONS = {
    "header": [], "breakdown": ["rank"], "usage": ["month_dt"], "tickets": ["created_date", "ticket_id"], "notes": ["ord"],
}


def write_pages(
    path: str, scored: DataFrame, usage: DataFrame, tickets: DataFrame, notes: DataFrame, cfg: Config = Config()
) -> None:
    """Writes the tables of the detail pages of all accounts below ``path``."""
    ranked = F.row_number().over(_by_contribution())
    tables = {
        "header": account_headers(scored), "breakdown": breakdown_long(scored).withColumn("rank", ranked),
        "usage": usage_series(usage, cfg), "tickets": ticket_timeline(tickets), "notes": note_rows(notes),
    }
    for name, order in SECTIONS.items():
        write_by_account(tables[name], f"{path.rstrip('/')}/{name}", order)


def _by_contribution() -> WindowSpec:
    # At most one row for each signal of an account.
    return Window.partitionBy("account_id").orderBy(F.desc("contribution"), "ord")


def read_page(spark: SparkSession, path: str, account_id: int) -> dict[str, DataFrame]:
    """The tables of one account, lazy and in order; the lookup reaches the scans as a pushed filter."""
    return {
        name: spark.read.parquet(f"{path.rstrip('/')}/{name}").where(F.col("account_id") == account_id).orderBy("account_id", *order)
        for name, order in SECTIONS.items()
    }


def page_rows(page: dict[str, DataFrame]) -> DataFrame:
    """A page in long form: section, account_id, place within the section, and the row's values as JSON."""
    def rows(name: str, df: DataFrame) -> DataFrame:
        values: Column = F.to_json(F.struct(*[c for c in df.columns if c != "account_id"]))
        order = SECTIONS[name]
        place = F.struct(*order) if order else F.struct(F.lit(0))
        return df.select(F.lit(name).alias("section"), "account_id", F.to_json(place).alias("place"), values.alias("payload"))

    return reduce(DataFrame.unionByName, [rows(name, df) for name, df in page.items()])
