"""Result output."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_scores(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scored accounts as parquet, one folder per tier."""
    scored.write.mode(mode).partitionBy("risk_tier").parquet(path)


def write_by_account(
    rows: DataFrame, path: str, order: list[str], mode: str = "overwrite", row_group_bytes: int = 8 * 1024 * 1024
) -> None:
    """Detail rows as parquet, range-partitioned by account and ``order``, with statistics and a bloom
    filter of the account in every row group. A point lookup then opens few files and reads one row group of
    an ordinary account, and one heavy account spans several files."""
    ordered = ["account_id", *order]
    (
        rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).write.mode(mode)
        .option("parquet.bloom.filter.enabled#account_id", "true").option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )
