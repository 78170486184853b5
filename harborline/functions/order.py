"""Positions and predecessors within a key, safe for a key of any size.

An ordinary key is handled in one window group. A key with more than
``heavy_rows`` rows is cut into pieces of consecutive rows; each piece is its own
window group, and one small row per piece carries the running count and the last
row over to the next piece. No task ever sorts a whole heavy key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.lineage import cut_lineage

_PIECE = ("_piece_major", "_piece_minor")
MAX_BROADCAST_SPLITS = 200_000


# No more keys than this are ever broadcast as heavy.
MAX_HEAVY_KEYS = 1_000_000


def heavy_keys(df: DataFrame, key: str, heavy_rows: int) -> DataFrame:
    """Keys with more than ``heavy_rows`` rows and more than a millionth of all
    rows. Fewer than a million keys can exceed that share, whatever the data, so
    the table is safe to broadcast."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    share = counted.agg(F.sum("_rows") / F.lit(MAX_HEAVY_KEYS)).scalar()
    heavy = counted.where((F.col("_rows") > heavy_rows) & (F.col("_rows") > share))
    return F.broadcast(heavy.select(key, F.lit(True).alias("_heavy")))


def piece_columns(major: str, ord_col: str, heavy_rows: int) -> dict[str, Column]:
    """The piece of a row: (NULL, NULL) for ordinary keys, otherwise the ``major``
    value and a range of ``heavy_rows`` consecutive input positions. Input
    positions are unique, so a piece holds at most ``heavy_rows`` rows."""
    heavy = F.col("_heavy")
    return {
        "_piece_major": F.when(heavy, F.col(major)),
        "_piece_minor": F.when(heavy, F.floor(F.col(ord_col) / F.lit(heavy_rows))),
    }


def with_positions(
    df: DataFrame, key: str, major: str, ord_col: str, carry: list[str], heavy_rows: int
) -> DataFrame:
    """Adds ``pos`` (1-based, by major then ord), ``series_length`` and ``prev``,
    a struct of the ``carry`` columns of the preceding row (NULL on the first).

    The rows are needed several times, so they are written once first."""
    df = cut_lineage(df)
    heavy = heavy_keys(df, key, heavy_rows)
    piece = piece_columns(major, ord_col, heavy_rows)
    group = Window.partitionBy(key, *_PIECE)
    ordered = group.orderBy(major, ord_col)
    here = F.struct(*carry)
    # The window shuffles on key and piece, so a heavy key spreads over many tasks.
    local = df.join(heavy, key, "left").withColumns(piece).withColumns({
        "_pos": F.row_number().over(ordered),
        "_len": F.count(F.lit(1)).over(group),
        "_prev": F.lag(here).over(ordered),
    })

    per_piece = (
        df.join(heavy, key).withColumns(piece)
        .groupBy(key, *_PIECE)
        .agg(F.count(F.lit(1)).alias("_n"), F.max_by(here, F.struct(major, ord_col)).alias("_last"))
    )
    by_key = Window.partitionBy(key)
    by_piece = by_key.orderBy(*_PIECE)
    running = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    links = per_piece.select(
        F.col(key).alias("_k"),
        F.col("_piece_major").alias("_k_major"),
        F.col("_piece_minor").alias("_k_minor"),
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_key).alias("_total"),
        F.lag("_last").over(by_piece).alias("_carried"),
    )
    joined = local.join(
        links,
        (F.col(key) == F.col("_k"))
        & (F.col("_piece_major") == F.col("_k_major"))
        & (F.col("_piece_minor") == F.col("_k_minor")),
        "left",
    )
    return joined.withColumns({
        "pos": F.col("_pos") + F.coalesce(F.col("_before"), F.lit(0)),
        "series_length": F.coalesce(F.col("_total"), F.col("_len")),
        "prev": F.when(F.col("_pos") > 1, F.col("_prev")).otherwise(F.col("_carried")),
    }).drop(
        "_pos", "_len", "_prev", "_k", "_k_major", "_k_minor", "_before", "_total", "_carried",
        "_heavy", *_PIECE,
    )


def with_file_order(scans: DataFrame | list[DataFrame], name: str = "ord", file: str | None = None) -> DataFrame:
    """Adds the position of each row across the scanned files (path, then offset), and the path too
    where ``file`` names its column. Several scans of different files are united by column name.

    Must be applied to file scans. Rows of one input split are numbered
    consecutively by Spark; one row per split gives each split its starting
    position. That table is broadcast while it is known to be short."""
    scans = scans if isinstance(scans, list) else [scans]
    split = ("_path", "_start")
    marked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        df.withColumns({
            "_path": F.col("_metadata.file_path"),
            "_start": F.col("_metadata.file_block_start"),
            "_row": F.monotonically_increasing_id(),
        }) for df in scans
    ])
    splits = marked.groupBy(*split).agg(F.min("_row").alias("_low"), F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    # A file is cut into pieces of a task's size and one remainder.
    most_splits = sum(len(df.inputFiles()) + df.rdd.getNumPartitions() for df in scans)
    if most_splits <= MAX_BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    placed = marked.join(starts, list(split)).withColumn(name, F.col("_offset") + F.col("_row") - F.col("_low"))
    if file is not None:
        placed = placed.withColumn(file, F.col("_path"))
    return placed.drop(*split, "_row", "_low", "_offset")


def latest(value: Column, *order: str) -> Column:
    """Value of the last row; NULL values count."""
    return F.max_by(value, F.struct(*order))
