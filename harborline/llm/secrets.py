"""Secret scans over content-addressed blobs, in DataFrame operations only.

A blob is the SHA-256 digest of a text; every historical version of every path is one. The
ledger is a table of (blob, rule, rule_version) pairs that were scanned, with the spans found.
``scan`` takes the distinct blobs, keeps the pairs that the ledger lacks, and runs only those
rules on only those blobs; ``findings`` joins the spans back to all paths. Changing a rule means
raising its version, which makes exactly that rule run again.

Spans come from Spark's own regular expressions: the text is split at the matches of a rule,
and the running lengths of the gaps and matches give the start and end of each match in code
points. Matches are leftmost and do not overlap within a kind; those that fail the rule's
minimal length are dropped afterwards, as the rule's own text may swallow a shorter match.

Defined results: a null text is the empty blob; empty texts, and empty tables, have no spans.
Equal texts are scanned once, and a null path is a path like any other. Texts are scanned whole.
Columns other than the path and the text are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions.heavy import salted_lookup
from harborline.llm.tables import small_table, text_of, written


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: the group whose length counts, and the least length
    group: int
    least: int
    #: a cheaper test that every text with a match passes, or empty
    hint: str = ""


#: In the order in which kinds at the same start are listed.
RULES = (
    Rule(
        "assign", 1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
    ),
    # A maximal run is found alike with the least length in the pattern, only cheaper.
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh"),
)
BASE = ("assign", "access", "hex")
#: Matches of a text that are walked at a time.
RUN = 256

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
LEDGER = T.StructType([
    T.StructField("blob", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("version", T.IntegerType()), T.StructField("spans", T.ArrayType(SPAN)),
])


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER))


def blobs(versions: DataFrame, path: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """path and blob of every version, and its batch where there is one."""
    more = [] if batch is None else [F.col(batch).alias("batch")]
    return versions.select(F.col(path).alias("path"), F.sha2(text_of(text).cast("binary"), 256).alias("blob"), *more)


def spans_of(rule: Rule, text: str = "text") -> Column:
    """The spans of a rule in a text, as an array of start and end."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(F.col(text), rule.pattern, -1), F.length)
    matches = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    counted = (
        F.transform(F.regexp_extract_all(F.col(text), pattern, F.lit(rule.group)), F.length)
        if rule.group else F.transform(matches, F.length)
    )
    both = F.arrays_zip(
        F.slice(gaps, 1, F.size(matches)).alias("gap"),
        F.transform(matches, F.length).alias("size"), counted.alias("counted"),
    )
    empty = F.array().cast(T.ArrayType(SPAN))

    def walked(run: Column) -> Column:
        """The end of a run of matches and its spans, from 0 on."""
        def step(state: Column, x: Column) -> Column:
            start = (state["at"] + x["gap"]).cast("long")
            end = (start + x["size"]).cast("long")
            span = F.array(F.struct(start.alias("start"), end.alias("end")))
            kept = F.when(x["counted"] >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"])
            return F.struct(end.alias("at"), kept.alias("spans"))

        return F.aggregate(run, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step)

    # Appending copies a list, so matches are walked in runs of bounded length and the runs are joined.
    runs = F.greatest(F.ceil(F.size(both) / RUN).cast("int"), F.lit(1))
    each = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: walked(F.slice(both, i * RUN + 1, RUN)))

    def joined(state: Column, run: Column) -> Column:
        at = state["at"]
        moved = F.transform(run["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))
        return F.struct((at + run["at"]).cast("long").alias("at"), F.concat(state["spans"], F.array(moved)).alias("spans"))

    nothing = F.array().cast(T.ArrayType(T.ArrayType(SPAN)))
    whole = F.flatten(F.aggregate(each, F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("spans")), joined)["spans"])
    has = F.col(text).contains(rule.hint) if rule.hint else F.col(text).rlike(rule.pattern)
    return F.when(has, whole).otherwise(empty)


def scan(versions: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The ledger rows of all blob and rule-version pairs that the ledger lacks."""
    spark = versions.sparkSession
    wanted = small_table(spark, [(r.kind, r.version) for r in rules], "kind string, version int")
    done = (
        ledger.join(F.broadcast(wanted), ["kind", "version"], "left_semi")
        .groupBy("blob").agg(F.collect_set("kind").alias("done"))
    )
    texts = versions.select(text_of(text).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    unseen = (
        texts.dropDuplicates(["blob"]).join(done, "blob", "left")
        .withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        .where(F.size("done") < len(rules))
    )
    found = F.array(*(
        F.when(
            ~F.array_contains("done", rule.kind),
            F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), spans_of(rule).alias("spans")),
        )
        for rule in rules
    ))
    scanned = unseen.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return scanned.select("blob", "x.kind", "x.version", "x.spans")


def findings(paths: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """path, blob and the spans of all kinds, ordered by start and then kind, of every version.

    The spans are gathered by blob first, so a blob with many paths is one row of the join."""
    order = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind"))
    current = small_table(paths.sparkSession, [(r.kind, r.version) for r in rules], "kind string, version int")
    hits = (
        ledger.join(F.broadcast(current), ["kind", "version"], "left_semi")
        .where(F.size("spans") > 0)
        .select("blob", F.transform(
            "spans", lambda s: F.struct(s["start"].alias("start"), order.alias("order"), F.col("kind").alias("kind"), s["end"].alias("end"))
        ).alias("spans"))
        .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    return salted_lookup(paths, hits, "blob", "path")


def scan_all(versions: DataFrame, ledger: DataFrame, rules=RULES, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The ledger with the new pairs, written to the shared folder, and the findings."""
    grown = written(ledger.unionByName(scan(versions, ledger, rules, text)), "ledger")
    return grown, findings(written(blobs(versions, path, text), "paths"), grown, rules)


def scan_batches(
    versions: DataFrame, ledger: DataFrame, batches: int = 3, rules=RULES, path: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``scan_all`` of versions that come in batches, dealt out by a hash of the path: each batch scans what the
    ledger of those before lacks. The findings tell the batch of a version, and whether its blob was
    scanned with an earlier one."""
    number = F.pmod(F.xxhash64(path), F.lit(batches)).cast("int")
    paths = written(blobs(versions.withColumn("_batch", number), path, text, "_batch"), "paths")
    for i in range(batches):
        ledger = written(ledger.unionByName(scan(versions.where(number == i), ledger, rules, text)), "ledger")
    first = paths.groupBy("blob").agg(F.min("batch").alias("first"))
    found = salted_lookup(findings(paths, ledger, rules), first, "blob", "path")
    return ledger, found.withColumn("reused", F.col("batch") > F.col("first")).drop("first")
