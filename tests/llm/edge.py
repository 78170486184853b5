"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, kept string, ids string, score string, block string"
LONG = "the quick brown fox jumps over the lazy dog " * 4000
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta", "en"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta", "en"),
    (3, None, None),
    (4, "", "de"),
    (None, "orphan row without an id", None),
    (None, None, None),
    (5, LONG, "en"),
    (6, LONG, "en"),
    (7, " \t\n ", "fr"),
    (8, "Ünïcode ÀÉ straße 中文 😀", "de"),
    (9, "x", "es"),
]


def edge_rows(spark):
    rows = [(i, t, lang, "s", 1, "r", "i", "k", "j", "z", "b") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_rows(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", F.col("text")).collect()]
