"""Running totals over all rows of a table in one order, without a task that sees them all.

The rows are range-partitioned by the order. Each partition sums up its own rows, and one small row
a partition carries the sum of the partitions before it. The result depends on the order only,
not on how the rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.lineage import cut_lineage


def with_running_total(df: DataFrame, order: list[Column | str], size: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows before this one. ``order`` must tell all rows
    apart. Whole rows are sorted, so pass narrow ones. The table of carries has one row a partition."""
    # Dealing by ranges reads the rows twice, for the bounds and for the rows, so they are made once before.
    ranged = cut_lineage(df.withColumn("_size", size)).repartitionByRange(*order)
    placed = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    per_part = placed.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_carried") + F.coalesce(F.sum("_size").over(here), F.lit(0))
    return placed.join(F.broadcast(carried), "_part").withColumn(name, total).drop("_part", "_size", "_carried")


def with_position(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds the place of a row in the order, from 0."""
    return with_running_total(df, order, F.lit(1).cast("bigint"), name)


def parts_of(start: Column, size: Column, limit: int) -> Column:
    """Packs consecutive items into parts of at most ``limit``: those that lie within one cell of that
    size form a part; an item that reaches over the end of its cell is a part of its own. Parts ascend
    with the items. Only an item that is itself larger exceeds the limit."""
    cell = F.floor(start / F.lit(limit))
    over = F.floor((start + size - 1) / F.lit(limit)) > cell
    return (2 * cell + over.cast("bigint")).cast("bigint")
