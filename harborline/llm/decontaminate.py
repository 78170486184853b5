"""Benchmark items found in texts with up to a share of edits.

Pigeonhole: an item of m characters and a budget of k edits is cut into k + 1 pieces; a text that
holds the item with at most k edits holds at least one piece unchanged at its place. An
Aho-Corasick automaton over the pieces finds all exact piece hits in one pass over a text. Hits of
one item whose windows overlap are verified together with Myers' bit-parallel edit distance
(pattern whole, text free at both ends), so no pair of text and item is formed without a hit.

Texts and items are compared after lower-casing, with every run of other characters than letters
and digits as one blank. ``edits`` is the least distance over the text, and ``start`` and ``end``
span its first place in the normalised text.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` normalised characters (or one item);
each block is broadcast by itself and every text is scanned against every block.

Defined results: a null or empty text matches nothing, and neither does an item without letters
or digits. Equal items are separate matches, repeated rows match alike, and a null id is kept as
it is. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.llm.tables import add_columns

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
BLOCK_CHARS = 1_000_000

MATCH = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
])
ARROW_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

_runs = re.compile(r"[^\W_]+").findall


def normalised(text: str) -> str:
    return " ".join(_runs(text.lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of near equal length with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def myers(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least distance of the pattern to any part of the text, and the first end of such a part."""
    ones, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = ones, 0, m
    best, end = m, 0
    get = pattern_masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus)
        down = plus & horizontal
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up <<= 1
        down <<= 1
        plus = (down | ~(vertical | up)) & ones
        minus = up & vertical & ones
        if distance < best:
            best, end = distance, at
    return best, end


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            if not text:
                continue
            budget = int(rate * len(text))
            i = len(self.items)
            self.items.append((item_id, text, budget, masks(text), masks(text[::-1])))
            for offset, piece in pieces(text, budget):
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.empty = not places
        if not self.empty:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[dict]:
        if self.empty or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (length, where) in self.automaton.iter(text):
            for i, offset in where:
                starts[i].add(last - length + 1 - offset)
        found = []
        for i in sorted(starts):
            item_id, item, budget, forward, backward = self.items[i]
            best = None
            for low, high in self.windows(sorted(starts[i]), len(item), budget):
                low = max(low, 0)
                part = text[low:high]
                edits, end = myers(forward, len(item), part)
                if edits <= budget and (best is None or edits < best[0]):
                    size = myers(backward, len(item), part[:end][::-1])[1]
                    best = (edits, low + end - size, low + end)
            if best:
                found.append({"item_id": item_id, "edits": best[0], "start": best[1], "end": best[2]})
        return found

    @staticmethod
    def windows(starts: list[int], m: int, budget: int) -> Iterator[tuple[int, int]]:
        """The parts of the text where an item may lie, given where its hits would start it."""
        low, high = starts[0] - budget, starts[0] + m + budget
        for s in starts[1:]:
            if s - budget <= high:
                high = s + m + budget
            else:
                yield low, high
                low, high = s - budget, s + m + budget
        yield low, high


_loaded: dict[tuple, Items] = {}


def _items(block: Broadcast, rate: float) -> Items:
    key = (hash(tuple(block.value)), rate)
    if key not in _loaded:
        if len(_loaded) >= 2:
            _loaded.clear()
        _loaded[key] = Items(block.value, rate)
    return _loaded[key]


def blocks(benchmark: DataFrame, id_column: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The normalised items in blocks; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    for row in rows.toLocalIterator():
        item = normalised(row.text or "")
        if block and size + len(item) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.id, item))
        size += len(item)
    if block:
        yield block


def with_matches(
    df: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = ERROR_RATE, item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Adds ``matches``: the item, edits and span of every item found in the text."""
    context = df.sparkSession.sparkContext
    columns = []
    out = df.drop("matches")
    for n, block in enumerate(blocks(benchmark, item_id, item_text)):
        shared = context.broadcast(block)

        def found(batch: pa.RecordBatch, shared=shared) -> list[pa.Array]:
            items = _items(shared, rate)
            texts = batch.column(text).to_pylist()
            return [pa.array([items.matches(normalised(t)) if t else [] for t in texts], ARROW_MATCHES)]

        name = f"_matches_{n}"
        out = add_columns(out, found, T.StructType([T.StructField(name, T.ArrayType(MATCH))]), text)
        columns.append(name)
    empty = F.array().cast(T.ArrayType(MATCH))
    return out.withColumn("matches", F.concat(empty, *columns)).drop(*columns)
