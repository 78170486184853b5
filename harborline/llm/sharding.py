"""Shards of near equal size by sampled splitters, in DataFrame operations only.

1. Every row becomes a row id, its id, its size and a key: a hash of its text, then a hash of
   its id and row id. Equal texts are neighbours in key order, and a group of any size can still be
   cut between its rows. Texts are not shuffled; the narrow table is written once.
2. About ``DRAWS`` rows a range are drawn with a chance that grows with their size (those with
   ``-ln(u) / size`` below the draws by all bytes, where u is a hash of the key), and their quantiles
   are the splitters. There is a range for every ``ROWS_A_RANGE`` rows, within the bounds of ``RANGES``.
   A splitter stands before a whole group of equal texts, unless the group is larger than
   ``WHOLE_GROUP`` of a shard: only such groups, fewer than shards / ``WHOLE_GROUP``, are cut between their rows.
3. Records are dealt to the key ranges between splitters. Ranges that hold more than ``OVERFULL``
   times their share are subdivided by splitters drawn from their own rows, all in one job, until none is left.
4. The exact sizes of the ranges, a fixed number of rows, give each range its offset, and a
   running sum within the range gives each row its place among all bytes. A row belongs to the
   shard in which the middle of its bytes falls, so shard sizes differ from the mean by less than
   one row at either end; a group of equal texts of up to ``WHOLE_GROUP`` of a shard lies in one
   range and follows its first row instead, so it is in one shard.

The law is ``bytes``: sizes are near equal. The size of a row is the UTF-8 length of its text plus
16; a null text has no bytes. Repeated rows, null ids and null texts are rows like any other. An
empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.tables import small_table, written

#: The least and the most ranges; a splitter is a literal of the plan.
RANGES = (512, 16384)
ROWS_A_RANGE = 1_000_000
DRAWS = 64
OVERFULL = 4.0
#: Groups up to this share of a shard stay together.
WHOLE_GROUP = 0.01
#: Hexadecimal digits of a key that name the group.
GROUP = 16


def keyed(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """row, id, size, text_crc32, and a key that orders the rows, written to the shared folder."""
    value = F.col(text).cast("string")
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.substring(F.sha2(F.coalesce(value, F.lit("")).cast("binary"), 256), 1, GROUP).alias("group"),
    )
    own = F.lpad(F.hex(F.xxhash64("id", "row")), 16, "0")
    return written(rows.withColumn("key", F.concat("group", own)), "keyed")


def _draw() -> Column:
    """A number for each row below which its chance, by bytes, must lie for it to be drawn."""
    u = (F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.col("size")


def _quantiles(keys: list[str], ranges: int) -> list[str]:
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _range_of(splitters: list[str]) -> Column:
    """How many splitters are at most the key: first among every 32nd, then between two of them."""
    if not splitters:
        return F.lit(0).cast("long")
    blocks = [splitters[i : i + 32] for i in range(0, len(splitters), 32)]
    heads = F.array(*(F.lit(b[0]) for b in blocks))
    block = F.size(F.filter(heads, lambda s: s <= F.col("key")))
    inner = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.greatest(block, F.lit(1)))
    return F.when(
        block == 0, F.lit(0).cast("long")
    ).otherwise(((block - 1) * 32 + F.size(F.filter(inner, lambda s: s <= F.col("key")))).cast("long"))


def _large_groups(rows: DataFrame, limit: float) -> set[str]:
    """The groups of more than ``limit`` bytes: fewer than all bytes by the limit."""
    sums = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    return {r.group for r in sums.where(F.col("bytes") > limit).select("group").collect()}


def range_partitioned(rows: DataFrame, limit: float, ranges: int | None = None, draws: int = DRAWS) -> tuple[DataFrame, list]:
    """The rows with their range, and (range, bytes, rows) of all ranges in key order. Groups of at
    most ``limit`` bytes lie in one range."""
    sums = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = sums.bytes or 0
    ranges = ranges or min(max(RANGES[0], sums.rows // ROWS_A_RANGE), RANGES[1])
    large = _large_groups(rows, limit)

    def border(key: str) -> str:
        return key if key[:GROUP] in large else key[:GROUP]

    drawn = rows.where(_draw() <= draws * ranges / max(total, 1)).select("key").collect()
    splitters = _quantiles(sorted(border(r.key) for r in drawn), ranges)
    share = total / ranges
    while True:
        dealt = rows.withColumn("range", _range_of(splitters))
        sizes = (
            dealt.groupBy("range")
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
            .orderBy("range").collect()
        )
        over = {r.range: r for r in sizes if r.bytes > OVERFULL * share and r.low < r.high and r.rows > 64}
        if not over:
            return dealt, sizes
        chance = F.create_map(*(F.lit(x) for r in over.values() for x in (r.range, 4096.0 / r.bytes)))
        inside = dealt.where(F.col("range").isin(list(over))).where(_draw() <= chance[F.col("range")])
        keys: dict[int, list[str]] = {}
        for r in inside.select("range", "key").collect():
            keys.setdefault(r.range, []).append(border(r.key))
        more = {
            k for number, own in keys.items()
            for k in _quantiles(sorted(own), int(over[number].bytes / share) + 1) if over[number].low < k <= over[number].high
        }
        if more <= set(splitters):
            return dealt, sizes
        splitters = sorted({*splitters, *more})


def shards(df: DataFrame, n: int = 40, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = keyed(df, id_column, text)
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = WHOLE_GROUP * total / n
    dealt, sizes = range_partitioned(rows, limit)
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r.range, at))
        at += r.bytes
    spark = df.sparkSession
    starts = small_table(spark, offsets, "range long, offset long")
    in_order = Window.partitionBy("range").orderBy("key", "row")
    placed = dealt.join(F.broadcast(starts), "range").withColumn(
        "before", F.col("offset") + F.sum("size").over(in_order) - F.col("size")
    )
    of_group = Window.partitionBy("range", "group")
    small = F.sum("size").over(of_group) <= limit
    first = F.struct("before", "size")
    lead = F.when(small, F.min(first).over(of_group)).otherwise(first)
    middle = lead["before"] + lead["size"] / 2
    shard = F.least(F.floor(middle * n / max(total, 1)), F.lit(n - 1)).cast("int")
    placed = written(placed.withColumn("shard", shard).select("row", "id", "size", "text_crc32", "range", "key", "shard"), "placed")
    # A shard takes neighbouring ranges whole or in part: the slot is the place within this
    # part, after the shard's rows in earlier ranges.
    parts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = Window.partitionBy("range", "shard").orderBy("key", "row")
    return placed.join(F.broadcast(parts), ["shard", "range"]).select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.row_number().over(own) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
