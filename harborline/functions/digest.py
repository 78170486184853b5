"""Digests of sets of rows that do not depend on their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_digest(text: Column) -> Column:
    """An aggregate: the sums of two 60-bit halves of each row's MD5, as text. Equal sets of rows give equal
    digests in any order, repeated rows count, and partial sums combine before a shuffle."""
    md5 = F.md5(text.cast("binary"))
    halves = [F.sum(F.conv(F.substring(md5, at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16)]
    return F.concat_ws(":", *halves)
