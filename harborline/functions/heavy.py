"""Lookups whose keys may be heavy: frequent keys are answered by a broadcast, the rest by a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is heavy.
SUPPORT = 1e-3


def heavy_values(rows: DataFrame, key: str, support: float = SUPPORT) -> DataFrame:
    """The values of ``key`` in more than ``support`` of the rows: candidates of a frequent-item summary,
    counted exactly. There are fewer than 1 / support, whatever the data."""
    candidates = rows.stat.freqItems([key], support).select(F.explode(f"{key}_freqItems").alias(key)).distinct()
    counted = rows.join(F.broadcast(candidates), key).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    share = rows.agg(F.count(F.lit(1)) * F.lit(support)).scalar()
    return counted.where(F.col("_rows") > share).select(key)


def lookup(rows: DataFrame, table: DataFrame, key: str, support: float = SUPPORT) -> DataFrame:
    """Left join of the rows to a table with one row for each ``key``.

    Rows with a heavy key meet the at most 1 / support table rows of those keys where they are; only the
    others are shuffled, and none of their keys holds more than ``support`` of the rows. The rows are read
    several times, so pass a written table."""
    heavy = F.broadcast(heavy_values(rows.select(key), key, support))
    frequent = rows.join(heavy, key, "left_semi").join(F.broadcast(table.join(heavy, key, "left_semi")), key, "left")
    return frequent.unionByName(rows.join(heavy, key, "left_anti").join(table, key, "left"))


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread_by: str, salts: int = 32, support: float = SUPPORT) -> DataFrame:
    """``lookup`` for a table whose rows may be large: the rows of a heavy key are dealt to ``salts``
    groups by ``spread_by``, and its one table row is repeated for each of them. Nothing but the heavy keys is broadcast."""
    heavy = F.broadcast(heavy_values(rows.select(key), key, support).withColumn("_heavy", F.lit(True)))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    own = rows.join(heavy, key, "left").withColumn("_salt", salt).drop("_heavy")
    every = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    other = table.join(heavy, key, "left").withColumn("_salt", F.explode(every)).drop("_heavy")
    return own.join(other, [key, "_salt"], "left").drop("_salt")
