"""Call-note files: records separated by three dashes, anywhere in the text.

The file is read as lines, so it splits at any size, and no separator can fall
across two splits. Counting separators before a line gives its record number:
per split inside the split, plus one running total over splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.config import NOTE_FILE_HEADER, NOTE_MIN_LENGTH, NOTE_SEPARATOR
from harborline.functions.text import strip


def read_note_records(spark: SparkSession, path) -> DataFrame:
    """Columns ``ord`` (record order over all files) and ``raw_text``."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.split("value", NOTE_SEPARATOR).alias("pieces"),
    ).withColumn("separators", F.size("pieces") - 1)

    # One row per input split.
    per_split = lines.groupBy("path", "start").agg(F.sum("separators").alias("_n"))
    in_order = Window.orderBy("path", "start")
    before = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    file_number = F.dense_rank().over(Window.orderBy("path"))
    offsets = per_split.select(
        "path", "start", (F.coalesce(before, F.lit(0)) + file_number).alias("offset")
    )

    in_split = Window.partitionBy("path", "start").orderBy("row")
    earlier = F.sum("separators").over(in_split.rowsBetween(Window.unboundedPreceding, -1))
    # The window has already placed the lines by split, so this join moves only
    # the offsets.
    numbered = lines.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(
        offsets, ["path", "start"]
    )
    pieces = numbered.select(
        "path", "start", "row", "offset", "earlier", F.posexplode("pieces").alias("pos", "piece")
    )
    part = F.struct("start", "row", "piece")
    records = pieces.groupBy(
        "path", (F.col("offset") + F.col("earlier") + F.col("pos")).alias("ord")
    ).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), "\n")
    return _without_headers(records.select("path", "ord", strip(text).alias("raw_text")))


def _without_headers(records: DataFrame) -> DataFrame:
    """Drops blank records, a leading header record per file, and short records."""
    filled = records.where(F.col("raw_text") != "")
    first = filled.groupBy("path").agg(F.min("ord").alias("ord"))
    titled = filled.where(F.contains("raw_text", F.lit(NOTE_FILE_HEADER))).select("path", "ord")
    headers = titled.join(first, ["path", "ord"]).select("ord")
    # Joined by record number, not by file: one file may hold all records.
    kept = filled.join(headers, "ord", "left_anti")
    return kept.where(F.length("raw_text") >= NOTE_MIN_LENGTH).select("ord", "raw_text")
