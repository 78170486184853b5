"""The corpus pipeline: stages over documents, each calling one operator of harborline.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, in whole rows.
Stages whose decisions come from another table than the rows themselves number the rows in a
written copy first, so null or repeated ids cannot mix up rows.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from harborline.functions.ship import ship_package  # noqa: E402
from harborline.llm import bpe, decontaminate, exact_dedup, minhash, toxicity  # noqa: E402
from harborline.llm.tables import documents, text_of, written  # noqa: E402

#: The tokenizer's vocabulary file, by its name among the public ones.
VOCABULARY = "word_bpe_49k.json"


def _private(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all columns but the used ones under private names, so no column that an operator
    adds can meet one of the caller's, and the way back to the caller's names."""
    names = [c if c in used else f"keep_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda rows: rows.select(*names).toDF(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _only(numbered: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows that the decisions keep; the narrow side is the one that is hashed."""
    kept = decisions.where("kept").select(F.col("row").alias("_row"))
    return numbered.join(kept.hint("shuffle_hash"), "_row", "left_semi")


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts below the rejection threshold of their language. The classifier learns from the
    labelled rows among the source documents."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.labelled_rows(documents(spark, sf_dir), labels))
    rows, back = _private(docs, "text", "lang")
    return back(toxicity.score(rows, model).where(~F.col("rejected")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    rows, back = _private(docs, "doc_id", "text")
    numbered = _numbered(rows)
    groups = exact_dedup.exact_groups(exact_dedup.digests(numbered, row="_row"))
    return back(_only(numbered, groups))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the smallest id."""
    ship_package(spark)
    rows, back = _private(docs, "doc_id", "text")
    numbered = _numbered(rows)
    return back(_only(numbered, minhash.classes(numbered, row="_row")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no benchmark item is found."""
    ship_package(spark)
    rows, back = _private(docs, "text")
    found = decontaminate.with_matches(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return back(found.where(F.size("matches") == 0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the digests of the ids and of the decoded text."""
    import public_tokenizers

    ship_package(spark)
    spec = bpe.load(spark, public_tokenizers.path(VOCABULARY))
    rows = bpe.encode_decode(docs.select("doc_id", "lang", "source", text_of().alias("text")), spec)
    return rows.select(
        "doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", non_toxic),
    ("exact_dedup", without_copies),
    ("minhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("bpe", tokens),
]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage reads what the one before has written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
