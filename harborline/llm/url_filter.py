"""URL rules found by host suffixes and path prefixes, in DataFrame operations.

Each URL is expanded into expressions: every suffix of its host at a label boundary, with every
prefix of its path. Only suffixes with as many labels, and prefixes of such lengths, as occur
among the rules can match, so no others are formed; this loses nothing and bounds the expansion
of a URL by the rules' distinct shapes. Expressions meet the rules in an equality join on the
first four bytes of their SHA-256 digest; the full digest then confirms, and the longest rule
wins (``allow`` before ``block`` on a tie). Spark broadcasts the rules only while they are
below its own size threshold and otherwise shuffles both sides on the short prefix.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z
lower-cased; the path runs from there up to ``?``, ``#`` or the end. A null URL, or one without
``://``, has an empty host and path and matches only rules of that shape. Without a rule the
verdict is ``default``. Every row of the input gives one row, repeated rows included; columns
other than the id and the URL are not read. A rule's own host and path must not be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.tables import ascii_lower, small_table

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return small_table(spark, [tuple(r) for r in rules], "verdict string, host string, path string")


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return df.withColumn("_rest", rest).select(
        *df.columns,
        ascii_lower(host).alias("host"),
        F.regexp_extract(F.expr("substring(_rest, length(regexp_extract(_rest, '^[^/?#]*', 0)) + 1)"), r"^[^?#]*", 0).alias("path"),
    )


def _digest(host, path):
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of every row."""
    shapes = rules.agg(
        F.collect_set(F.size(F.split("host", r"\.", -1))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    digest = _digest(F.col("host"), F.col("path"))
    known = rules.select(
        F.substring(digest, 1, 8).alias("short"), digest.alias("digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("length"),
            (F.col("verdict") == "allow").alias("allow"),
            F.concat("host", "path").alias("rule"), F.col("verdict"),
        ).alias("match"),
    ).distinct()
    parts = with_host_and_path(pages.select(F.col(id_column).alias("id"), F.col(url).alias("url")))
    rows = parts.select(F.monotonically_increasing_id().alias("row"), "id", "host", "path").withColumn("names", F.split("host", r"\.", -1))
    suffixes = F.filter(
        F.array(*(
            F.when(
                F.size("names") >= n,
                F.array_join(F.slice(F.col("names"), F.size("names") - F.lit(n - 1), n), "."),
            )
            for n in sorted(shapes.labels)
        )) if shapes.labels else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    prefixes = F.filter(
        F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shapes.lengths)))
        if shapes.lengths else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    expressions = (
        rows.withColumn("suffix", F.explode_outer(suffixes)).withColumn("prefix", F.explode_outer(prefixes))
        .withColumn("full", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("full", 1, 8))
    )
    met = expressions.join(known, "short", "left").withColumn(
        "match", F.when(F.col("full") == F.col("digest"), F.col("match"))
    )
    best = met.groupBy("row", "id", "host", "path").agg(F.max("match").alias("match"))
    return best.select(
        F.col("id").alias(id_column), "host", "path", F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", F.lit(default)).alias("verdict"),
    )
