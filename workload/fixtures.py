"""Account-health inputs derived from the driver's tables.

Each view is written in the SQL that Spark and DuckDB share, so a query and its
oracle read the same rows. Every view reads its whole tables.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from harborline.config import Config
from harborline.functions.lineage import shared_folder
from harborline.operators.clean import clean_accounts, clean_nps, clean_tickets, clean_usage
from harborline.operators.notes import extract_fields
from harborline.plans.scoring import score_accounts
from harborline.sources.sinks import write_scores

TABLES = {
    "fx_accounts": ("region", "nation", "customer", "part"), "fx_usage": ("events",),
    "fx_tickets": ("orders",), "fx_nps": ("documents",), "fx_notes": ("documents",),
}

VIEWS = {
    "fx_accounts": """
SELECT c_custkey AS account_id,
       coalesce(p_name, 'plain part') || ' ' || lower(c_mktsegment) || ' '
         || translate(CAST(c_custkey AS VARCHAR(20)), '0123456789', 'abcdefghij') || ' ' AS account_name,
       CAST(c_acctbal AS DECIMAL(18,2)) AS arr, ' ' || c_mktsegment || '  ' AS plan_tier,
       'IND_' || CAST(c_custkey % 7 AS VARCHAR(10)) AS industry,
       n_name AS csm_name, r_name AS region,
       DATE '2026-06-09' + CAST((c_custkey * 37) % 240 - 90 AS INT) AS contract_end_date,
       c_custkey AS ord
FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON p_partkey = c_custkey""",
    "fx_usage": """
SELECT user_id AS account_id, CAST(b AS BIGINT) AS ord,
       CASE b WHEN 0 THEN '2025-10' WHEN 1 THEN '2025-11' WHEN 2 THEN '2025-12'
              WHEN 3 THEN '2026-01' WHEN 4 THEN '2026-02' ELSE '2026-03' END AS month,
       CAST(n AS DOUBLE) * f AS api_calls, CAST(h AS DOUBLE) * f AS active_users,
       CAST(k AS DOUBLE) * f AS content_entries_created,
       CASE WHEN (user_id + b) % 11 = 0 THEN 'n/a'
            ELSE CAST(p AS VARCHAR(20)) END AS workflows_triggered,
       CASE (user_id + CASE WHEN b >= 4 THEN 1 ELSE 0 END) % 9
            WHEN 0 THEN 'v3.1.2' WHEN 1 THEN 'v3.2.0' WHEN 2 THEN 'v3.4.1'
            WHEN 3 THEN 'v4.0.0' WHEN 4 THEN 'v4.1.0' WHEN 5 THEN 'v4.2.3'
            WHEN 6 THEN 'v4.3.2' WHEN 7 THEN 'v3.9.9' ELSE 'v5.0-beta' END AS sdk_version
FROM (SELECT *, CASE WHEN b <= 2 THEN 1.0E0 WHEN user_id % 10 = 0 THEN 0.25E0
                     WHEN user_id % 10 = 5 THEN 0.5E0 ELSE 1.0E0 END AS f
      FROM (SELECT user_id, b, count(*) AS n, count(DISTINCT hour(ts)) AS h,
                   CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS k,
                   CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS p
            FROM (SELECT user_id, ts, event_type,
                         CAST(least(floor((day(ts) - 1) / 5), 5) AS INT) AS b FROM events) e
            GROUP BY user_id, b) g) t""",
    "fx_tickets": """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS ticket_id, o_custkey AS account_id,
       DATE '2026-06-09' - CAST((o_orderkey * 13) % 180 AS INT) AS created_date,
       'p' || substring(o_orderpriority, 1, 1) || ' ' AS priority,
       CASE o_orderstatus WHEN 'O' THEN ' open' WHEN 'P' THEN 'ESCALATED'
            ELSE 'resolved' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 240) / 2.0E0 END AS resolution_time_hours,
       CASE o_orderkey % 9 WHEN 0 THEN 'SDK upgrade guidance'
            WHEN 1 THEN 'REST API deprecation migration'
            WHEN 2 THEN 'Migration from legacy editor'
            WHEN 3 THEN 'Locale fallback not working'
            WHEN 4 THEN 'Workflow automation broken' WHEN 5 THEN 'New editor crash'
            WHEN 6 THEN 'Custom field rendering issue' WHEN 7 THEN 'Billing question'
            END AS subject,
       CASE o_orderkey % 5 WHEN 0 THEN 'Recurring issue' WHEN 1 THEN 'Blocking release'
            WHEN 2 THEN 'Locale fallback seen' WHEN 3 THEN 'How to' END AS description
FROM orders""",
    "fx_nps": """
SELECT CAST(floor(doc_id / 2) AS BIGINT) AS account_id, CAST((doc_id * 7) % 12 AS INT) AS score,
       CASE doc_id % 7 WHEN 0 THEN 'Great team. ' WHEN 1 THEN 'Too expensive: ' WHEN 3 THEN 'watching competitors closely '
            WHEN 4 THEN ' ' WHEN 5 THEN 'Best product, easily ' ELSE '' END || text AS verbatim_comment,
       doc_id AS ord
FROM documents
UNION ALL
SELECT CAST(floor(doc_id / 2) AS BIGINT), CAST((doc_id * 7) % 12 AS INT), CASE doc_id % 2 WHEN 0 THEN ' ' END, -1 - doc_id
FROM documents""",
    "fx_notes": """
SELECT doc_id AS ord, doc_id AS true_account_id,
       CASE doc_id % 4
            WHEN 0 THEN '2026-03-20 | ' || coalesce(trim(account_name), 'nobody known') || ' | James O.'
            WHEN 1 THEN 'acct ' || lpad(CAST(doc_id AS VARCHAR(20)), 4, '0') || ' - quick'
            WHEN 2 THEN 'Mar 12 -- ' || replace(coalesce(trim(account_name), 'quite unknown'), 'in', 'im')
            ELSE 'Talked to ' || upper(coalesce(trim(account_name), 'someone')) || '. priya called'
            END || chr(10) ||
       CASE doc_id % 7 WHEN 0 THEN 'champion nervous, lost faith; VP joined; missed QBR, no show; budget cut; evaluating Strapi and Sanity'
            WHEN 1 THEN 'evaluating Strapi and Sanity, budget cut'
            WHEN 2 THEN 'no show, no-show again' WHEN 3 THEN 'happy, expanding'
            WHEN 4 THEN 'merger planned, moving to WordPress'
            WHEN 5 THEN 'happy but frustrated' ELSE 'routine' END || chr(10) || text AS raw_text
FROM documents LEFT JOIN fx_accounts ON account_id = doc_id""",
}


#: The folders of the score tables of this process, by application, input and state of the input.
_SCORES: dict[tuple, str] = {}


@dataclass
class Inputs:
    """The cleaned inputs of one scale factor, all lazy."""

    spark: SparkSession
    sf_dir: str
    cfg: Config = Config()

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._tables: dict[str, DataFrame] = {}

    def raw(self, view: str) -> DataFrame:
        """A view over the tables, before the clean-up."""
        for name in TABLES[view]:
            if name not in self._tables:
                self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            # Views are per session and another Inputs may have replaced them.
            self._tables[name].createOrReplaceTempView(name)
        if view == "fx_notes":
            self.raw("fx_accounts").createOrReplaceTempView("fx_accounts")
        return self.spark.sql(VIEWS[view])

    @cached_property
    def accounts(self) -> DataFrame:
        return clean_accounts(self.raw("fx_accounts"), self.cfg)

    @cached_property
    def usage(self) -> DataFrame:
        return clean_usage(self.raw("fx_usage"))

    @cached_property
    def raw_tickets(self) -> DataFrame:
        return self.raw("fx_tickets")

    @cached_property
    def tickets(self) -> DataFrame:
        return clean_tickets(self.raw_tickets)

    @cached_property
    def nps(self) -> DataFrame:
        return clean_nps(self.raw("fx_nps"))

    @cached_property
    def note_records(self) -> DataFrame:
        return self.raw("fx_notes")

    @cached_property
    def notes(self) -> DataFrame:
        return extract_fields(self.note_records.select("ord", "raw_text"), self.cfg)

    @cached_property
    def known_notes(self) -> DataFrame:
        """Notes with the account they were written for, as an exact stand-in for
        the matcher where a query must be checked against SQL."""
        return self.note_records.withColumnRenamed("true_account_id", "matched_account_id")

    @cached_property
    def fresh_scores(self) -> DataFrame:
        """All accounts scored from the sources, lazily."""
        return score_accounts(
            self.accounts, self.usage, self.tickets, self.nps, self.known_notes,
            self.cfg, window_only=False,
        )

    @cached_property
    def scored(self) -> DataFrame:
        """The written score table that the reports read. It is written by the first report of a Spark
        application, and again once an input file has changed."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.cfg, self._state())
        if key not in _SCORES:
            path = f"{shared_folder(self.spark)}/scores-{uuid.uuid4().hex}"
            write_scores(self.fresh_scores, path)
            _SCORES[key] = path
        return self.spark.read.parquet(_SCORES[key])

    def _state(self) -> tuple:
        """Size and time of each input table."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        state = []
        for name in sorted({table for tables in TABLES.values() for table in tables}):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
            files = path.getFileSystem(conf)
            state.append((files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime()))
        return tuple(state)
