"""Spelling variants: words that differ by one character, found by asymmetric chunks.

1. Words. Each task counts the words of its texts before any shuffle; counts add up by word.
2. Chunks. A word of length L is cut in half. Its two disjoint halves are its chunks: one edit leaves
   one of them as it was, and the other half is the region of the edit. The other word of a pair gives
   its positional grams of the same lengths: for words of its own length L at the chunk's place, for
   words one longer at that place or, behind the region, one before it. So a join on (L, region, gram)
   with a shift of at most one meets every pair, and ``levenshtein`` with a bound of one verifies it. Only the
   longer word of a pair gives chunks to the shorter; of two equally long words either does, once.
3. Hot chunks. Where more than ``BUCKET`` rows share a chunk, no pairs are formed: the region is cut in half
   again, so the kept part grows by one of the new halves, and only those rows go on. A region of one
   character ends this, as all words that agree elsewhere are near each other. Whatever the
   words, a bucket makes at most ``BUCKET`` squared candidates, or near pairs only.
4. Forms. Both directions of each pair are summed by word. Roots follow the forms by pointer
   doubling; as each form occurs at least twice as often as its word, six doublings reach the end.

Everything after the counting is DataFrame code. Tables between the rounds are written to the shared folder.

Defined results: a null text has no words; a null id counts as the empty text in the hash. Repeated
rows count each time. Words are compared by code points. An empty table gives an empty result. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.tables import slices, text_of, written

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One run in so many of a document loses a code point.
SPARED = 97
#: Rows of a chunk above which its region is cut again.
BUCKET = 64
#: Rows of a table up to which it may be broadcast.
BROADCAST_ROWS = 200_000
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 500_000
#: Code points of a text that are searched at once.
PIECE = 1 << 20

runs_of = re.compile("[a-zÀ-ÿ]+").findall
break_after = re.compile("[^a-zÀ-ÿ]").search


def document_words(id_, text: str) -> Iterator[tuple[str, int]]:
    """The words of one document after the deletions, with their counts; a word may come twice."""
    text = text.encode().lower().decode()  # bytes: A to Z only
    counts: Counter[str] = Counter()
    at = 0
    while at < len(text):
        found = break_after(text, min(at + PIECE, len(text)))
        end = found.start() if found else len(text)
        counts.update(runs_of(text[at:end]))
        at = end
    start = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % SPARED == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def rows(least: int) -> Iterator[pa.RecordBatch]:
        if len(held) >= least:
            words = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )
            held.clear()
            yield from slices(words, "word")

    for batch in batches:
        for part in slices(batch, "text"):
            for id_, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                for word, n in document_words(id_, text):
                    held[word] += n
                yield from rows(HELD_WORDS)
    yield from rows(1)


def words(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of the words with at least ``LEAST_COUNT`` occurrences."""
    rows = df.select(F.col(id_column).alias("id"), text_of(text).alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _cut(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.explode(F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high"))))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the chunk: all of a word outside the region, for words of the length ``full``."""
    before = F.substring("word", F.lit(1), F.col("low"))
    behind = F.expr("right(word, full - high)")
    return rows.withColumn("key", F.xxhash64("full", "low", "high", before, F.lit("\0"), behind))


def _regions(vocabulary: DataFrame) -> DataFrame:
    """Each word with its own chunks and with its grams against words one longer."""
    length = F.length("word")
    sides = vocabulary.select("word", "n", F.explode(F.array(length, length + 1)).alias("full"))
    return _keyed(sides.select("word", "n", "full", _cut(F.lit(0), F.col("full")).alias("region")).select("word", "n", "full", "region.*"))


def _small(df: DataFrame) -> DataFrame:
    """The table, broadcast if its rows have been counted and are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _near_in(rows: DataFrame) -> DataFrame:
    """The verified pairs of words within the chunks of a round."""
    own = rows.where(F.length("word") == F.col("full")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    distinct = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
    near = F.expr("levenshtein(a, b, 1)") == 1
    return own.join(other, "key").where(distinct & near).select("a", "a_n", "b", "b_n")


def near_pairs(vocabulary: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, a_n, b, b_n: each pair of words one edit apart, once."""
    rows = written(_regions(vocabulary), "chunks")
    found = None
    while True:
        open_ = F.col("high") - F.col("low") > 1
        hot = written(rows.where(open_).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bucket), "hot-chunks")
        small = _small(hot.select("key"))
        pairs = written(_near_in(rows.join(small, "key", "left_anti")), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        if hot.isEmpty():
            return found.dropDuplicates(["a", "b"])
        again = rows.join(small, "key", "left_semi").select("word", "n", "full", _cut(F.col("low"), F.col("high")).alias("region"))
        rows = written(_keyed(again.select("word", "n", "full", "region.*")), "chunks")


def _roots(links: DataFrame) -> DataFrame:
    """word and root: the last word that the forms lead to."""
    roots = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(roots.join(further, "root", "left"), "roots")
        if joined.where("next IS NOT NULL").isEmpty():
            return joined.select("word", "root")
        roots = joined.select("word", F.coalesce("next", "root").alias("root"))


def variants(vocabulary: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of a table of distinct words with counts."""
    vocabulary = written(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_pairs(vocabulary, bucket)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("row")).select("row.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    formed = F.col("near_n") >= 2 * F.col("n")
    rows = written(
        vocabulary.join(best, "word", "left").select(
            "word", F.when(formed, F.col("near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
