"""Exact dedup with a split for heavy hitters, in DataFrame operations only.

1. Every row becomes a row id, its id and the SHA-256 digest of its normalised text. This
   narrow table is written once; texts are never shuffled.
2. ``freqItems``, Spark's distributed Misra-Gries summary, names every digest that holds more
   than ``support`` of the rows, at most ``1 / support`` of them plus false positives of the
   same bound. Their exact counts and winners are then computed and verified, so only digests
   that really are that frequent go on.
3. The verified winners (at most ``1 / support`` rows, a bound that does not depend on the
   data) are broadcast: their rows are decided on the map side and are never shuffled by digest.
4. The rest is grouped by digest in an ordinary shuffle; no group there exceeds ``support``.

Texts are equal when identical after lower-casing A to Z only; null counts as empty. Of equal
texts the row with the largest id stays; among rows with the same id, the one with the largest
row id, and a null id is the smallest. Every input row gives one row, an empty table gives none,
and columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.tables import ascii_lower, text_of, written

#: A digest with more than this share of all rows is a heavy hitter.
SUPPORT = 1e-3


def digests(df: DataFrame, id_column: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """row, id and digest of each row, written to the shared folder."""
    row_id = F.monotonically_increasing_id() if row is None else F.col(row)
    return written(
        df.select(
            row_id.alias("row"), F.col(id_column).alias("id"),
            F.sha2(ascii_lower(text_of(text)).cast("binary"), 256).alias("digest"),
        ),
        "digests",
    )


def heavy_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """digest, keep, group_size of the digests that hold more than ``support`` of the rows."""
    candidates = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest")).distinct()
    counted = (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest").agg(_winner().alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    total = rows.count()
    return counted.where(F.col("group_size") > support * total)


def _winner():
    return F.max(F.struct(F.col("id"), F.col("row")))


def exact_groups(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """row, id, digest, keep_id, keep_row, group_size of every row of ``digests``."""
    heavy = written(heavy_digests(rows, support), "heavy")
    is_heavy = F.broadcast(heavy)
    frequent = rows.join(is_heavy, "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(_winner().alias("keep"), F.count(F.lit(1)).alias("group_size"))
    both = frequent.unionByName(rest.join(groups, "digest"))
    return both.select(
        "row", "id", "digest", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size",
        (F.col("keep.row") == F.col("row")).alias("kept"),
    )
