"""Near-duplicate texts by DartMinHash signatures, banded joins and verified links.

A text is the weighted set of its runs of five words, each with weight 1 or with the number of
its occurrences. Every element owns a plane of weight by rank on which darts fall as a Poisson
process of rate 1, the same for all texts; a dart hits if it lies below the element's weight. A
dart belongs to one of k coordinates, and a coordinate keeps the hit of the lowest rank. Two texts
agree in a coordinate with the probability of their weighted Jaccard similarity. Ranks are drawn
in cells up to a limit of about ``k ln k`` over the text's weight, so a long text costs little more
than reading it; a text with an empty coordinate raises its limit until all are filled.

1. One pass makes, for each row, a digest of its words, the band keys of its signature and
   the sorted element hashes. Rows with the same words are one text from here on.
2. Texts meet in an equality join on the band's key. Within a bucket the texts are compared to
   pivots: the smallest text that no earlier pivot is connected with meets all texts of other
   components in the bucket, earlier pivots' ones too, so links across pivots are found. One
   pivot settles a bucket of copies; for what it leaves open, each further round takes the smallest text
   of up to ``PIVOTS`` open components. Rounds end when every text of a bucket is connected with one of its pivots,
   however large it is. Then no pair of two texts is left but those where neither was a pivot of the bucket: where
   two components have more than one text each in a bucket, all these are compared, blocks of texts against
   blocks, each pair in the first bucket it shares. That is every pair the rounds left out, so it takes one
   pass: components its links join have no further pair to compare. Nothing is capped. From the second round on, texts and pivots carry sketches, the
   counts of their elements by hash group: the sum of the smaller counts bounds the common elements
   from above, so a pair whose bound is too low is no link and is left out before it becomes a row.
3. Each pair is verified once on its whole sets of 32-bit element hashes; links are those of at least ``THRESHOLD``.
4. Connected components of the links are the classes. Each round contracts them: texts move to
   their smallest neighbour until no edge is left, and only new edges between components go on.

With 40 bands of 7 rows a pair of similarity 0.8 meets in a band with probability 0.9999.

Defined results: a null text is empty; texts without words form one class, as equal texts do, and
a text of fewer than five words is one run of all its words. Null ids and repeated rows are rows
like any other: each gets its class, and one row of a class stays, that with the smallest id
(null last), then the smallest row id. An empty table gives an empty result. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.heavy import lookup
from harborline.llm.tables import add_columns, text_of, written
from harborline.llm.words import mixed, shingle_hashes, word_hashes

THRESHOLD = 0.8
WORDS = 5
BANDS = 40
ROWS = 7
#: Pivots of a bucket in one round after the first, at most.
PIVOTS = 64
#: Elements of the texts of one block, about, when what the pivots left is compared.
BLOCK_ELEMENTS = 1 << 17
#: Groups of a sketch, at most, while a group has few elements.
MOST_GROUPS = 1024
#: Element by rank cells that are drawn at once.
CHUNK = 400_000
#: Cells below rank 1: [0, 2^-LOW), then doubling.
LOW = 8

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _poisson_levels(rate: float) -> np.ndarray:
    """Uniform 64-bit values from which on a cell of this rate has 1, 2, ... darts."""
    levels, p, total = [], math.exp(-rate), 0.0
    for n in range(12):
        total += p
        levels.append(min(int(total * 2.0**64), 2**64 - 1))
        p *= rate / (n + 1)
    return np.array(levels, np.uint64)


_LEVELS = {rate: _poisson_levels(rate) for rate in [2.0**-i for i in range(LOW + 1)]}


def _cells(limit: int) -> list[tuple[float, float]]:
    """(lowest rank, width) of the cells up to a limit, which is a whole number."""
    small = [(0.0, 2.0**-LOW)] + [(2.0**-i, 2.0**-i) for i in range(LOW, 0, -1)]
    return small + [(float(m), 1.0) for m in range(1, limit)]


class Signatures:
    def __init__(self, k: int):
        self.k = k
        self.darts = k * (math.log(k) + 2)

    def limit(self, weight: float) -> int:
        """The first rank limit for a text: a power of two, 1 at least."""
        return 1 << max(0, math.ceil(math.log2(max(self.darts / max(weight, 1e-9), 1))))

    def _darts(self, elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: int):
        """Owner, coordinate, rank and identity of the hits of all elements below the limit.

        A weight above 1 is several units of the element, each with its own unit of the plane."""
        units = np.ceil(weights).astype(np.int64)
        index = np.repeat(np.arange(len(elements)), units)
        unit = np.arange(len(index)) - np.repeat(np.cumsum(units) - units, units)
        seeds = mixed(elements[index] + GOLDEN * (unit + 1).astype(np.uint64))
        top = weights[index] - unit
        found = []
        cells = _cells(limit)
        small, large = cells[: LOW + 1], cells[LOW + 1 :]
        for n, (low, width) in enumerate(small):
            found.append(self._cell(seeds, top, owner[index], np.full(len(seeds), n), np.full(len(seeds), low), width))
        per = max(1, CHUNK // max(len(seeds), 1))
        for at in range(0, len(large), per):
            part = large[at : at + per]
            lows = np.repeat(np.array([c[0] for c in part]), len(seeds))
            cell = np.repeat(np.arange(at, at + len(part)) + LOW + 1, len(seeds))
            found.append(self._cell(np.tile(seeds, len(part)), np.tile(top, len(part)), np.tile(owner[index], len(part)), cell, lows, 1.0))
        return [np.concatenate(x) for x in zip(*found)]

    def _cell(self, seeds, top, owner, cell, low, width):
        own = mixed(seeds ^ (GOLDEN * (cell.astype(np.uint64) + np.uint64(1))))
        counts = np.searchsorted(_LEVELS[width], own, side="right")
        hit = np.flatnonzero(counts)
        times = counts[hit]
        index = np.repeat(hit, times)
        nth = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
        identity = mixed(own[index] + GOLDEN * (nth + 1).astype(np.uint64))
        place = mixed(identity ^ np.uint64(0x5851F42D4C957F2D))
        rank = low[index] + width * ((identity >> np.uint64(11)).astype(np.float64) / 2.0**53)
        height = (place >> np.uint64(11)).astype(np.float64) / 2.0**53
        inside = height < top[index]
        coordinate = (mixed(place) % np.uint64(self.k)).astype(np.int64)
        return owner[index][inside], coordinate[inside], rank[inside], identity[inside]

    def of(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The signature of each non-empty weighted set, one row of k identities each."""
        out = np.zeros((len(sets), self.k), np.uint64)
        waiting = [(self.limit(float(w.sum())), i) for i, (e, w) in enumerate(sets) if len(e)]
        while waiting:
            waiting.sort()
            again, at = [], 0
            while at < len(waiting):
                limit, group, size = waiting[at][0], [], 0
                while at < len(waiting) and waiting[at][0] == limit and (not group or size < CHUNK):
                    i = waiting[at][1]
                    group.append(i)
                    size += len(sets[i][0]) * (limit + LOW)
                    at += 1
                elements = np.concatenate([sets[i][0] for i in group])
                weights = np.concatenate([sets[i][1] for i in group])
                owner = np.repeat(np.arange(len(group)), [len(sets[i][0]) for i in group])
                owners, coordinate, rank, identity = self._darts(elements, weights, owner, limit)
                order = np.argsort(-rank, kind="stable")
                slot = owners[order] * self.k + coordinate[order]
                flat = np.zeros(len(group) * self.k, np.uint64)
                filled = np.zeros(len(group) * self.k, bool)
                flat[slot] = identity[order]  # the lowest rank is written last
                filled[slot] = True
                full = filled.reshape(-1, self.k).all(axis=1)
                out[group] = flat.reshape(-1, self.k)
                again += [(limit * 2, i) for i, ok in zip(group, full) if not ok]
            waiting = again
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), parts.shape[:2])
    for r in range(rows):
        key = mixed(key * np.uint64(3) + parts[:, :, r])
    return key


def weighted_shingles(words: np.ndarray, length: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    elements = shingle_hashes(words, length)
    if not counted or len(words) < length:
        return elements, np.ones(len(elements))
    n = len(words) - length + 1
    value = np.full(n, length, np.uint64)
    for i in range(length):
        value = mixed(value * GOLDEN + words[i : i + n])
    return tuple(np.unique(value, return_counts=True))


def sketch(elements: np.ndarray) -> bytes:
    """Counts of 32-bit hashes by their remainder to a power of two, about four a group for usual
    texts. Empty, which bounds nothing, if a count does not fit a byte."""
    groups = 1 << max(4, (max(min(len(elements) // 4, MOST_GROUPS), len(elements) // 64) - 1).bit_length())
    counts = np.bincount(elements & np.uint32(groups - 1), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(own: bytes, others: list[bytes], threshold: float) -> np.ndarray:
    """Which of the others can have a similarity of the threshold or more, by the sketches' bound."""
    possible = np.ones(len(others), bool)
    if not own:
        return possible
    of_size = {}
    for i, other in enumerate(others):
        if other:
            of_size.setdefault(len(other), []).append(i)
    mine = np.frombuffer(own, np.uint8).astype(np.int32)
    for size, index in of_size.items():
        groups = min(size, len(mine))
        theirs = np.frombuffer(b"".join([others[i] for i in index]), np.uint8).astype(np.int32)
        theirs = theirs.reshape(len(index), -1, groups).sum(axis=1)
        same = mine.reshape(-1, groups).sum(axis=0)
        common = np.minimum(theirs, same).sum(axis=1)
        possible[index] = common >= threshold * (same.sum() + theirs.sum(axis=1) - common)
    return possible


def _possible(met: DataFrame, threshold: float) -> DataFrame:
    """Rows (text, label, sketch, pivots) with the pivots that may be linked, without sketches."""

    def work(batches):
        for batch in batches:
            pivots = batch.column("pivots")
            at, inner = pivots.offsets.to_numpy(), pivots.values
            own, sketches = batch.column("sketch").to_pylist(), inner.field("sketch")
            kept = [may_link(own[i], sketches[at[i] : at[i + 1]].to_pylist(), threshold) for i in range(batch.num_rows)]
            ends = np.concatenate([[0], np.cumsum([k.sum() for k in kept])]).astype(np.int32)
            chosen = pa.array(np.flatnonzero(np.concatenate(kept)) + at[0])
            few = pa.StructArray.from_arrays([inner.field(c).take(chosen) for c in ("text", "label")], names=["text", "label"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("text"), batch.column("label"), pa.ListArray.from_arrays(pa.array(ends), few)], names=["text", "label", "pivots"]
            )

    return met.mapInArrow(work, "text long, label long, pivots array<struct<text: long, label: long>>").where(F.size("pivots") > 0)


def signed(df: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS, counted: bool = False) -> DataFrame:
    """Adds digest (of the words), bands (keys), elements (32-bit hashes, sorted) and their sketch."""

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        maker = Signatures(bands * rows)
        found = [word_hashes(t or "") for t in batch.column(text).to_pylist()]
        sets = [weighted_shingles(w, words, counted) for w in found]
        keys = band_keys(maker.of(sets), bands, rows).view(np.int64)
        short = [np.unique((e >> np.uint64(32)).astype(np.uint32)) for e, _ in sets]
        return [
            pa.array([hashlib.blake2b(w.tobytes(), digest_size=16).hexdigest() for w in found]),
            pa.array([k if len(e) else [] for k, (e, _) in zip(keys, sets)], pa.list_(pa.int64())),
            pa.array([x.view(np.int32) for x in short], pa.list_(pa.int32())),
            pa.array([sketch(x) for x in short], pa.binary()),
        ]

    return add_columns(df, made, "digest string, bands array<long>, elements array<int>, sketch binary", text)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (low, high) with linked: whether their exact sets are alike."""
    both = (
        pairs.join(sets.select(F.col("text").alias("low"), F.col("elements").alias("low_set")), "low")
        .join(sets.select(F.col("text").alias("high"), F.col("elements").alias("high_set")), "high")
    )
    common = F.size(F.array_intersect("low_set", "high_set"))
    return both.select(*pairs.columns, (common >= threshold * (F.size("low_set") + F.size("high_set") - common)).alias("linked"))


def _pivots(buckets: DataFrame, carried: list[str]) -> DataFrame:
    """key, pivot: of each bucket the smallest open text, or, once sketches are carried, the smallest
    texts of its first ``PIVOTS`` open components. Either is cut down before rows are shuffled by key."""
    opened, text = buckets.where("open"), F.min(F.struct("text", "label", *carried)).alias("pivot")
    if not carried:
        return opened.groupBy("key").agg(text)
    place = F.row_number().over(Window.partitionBy("key").orderBy("pivot.text"))
    return opened.groupBy("key", "label").agg(text).withColumn("place", place).where(F.col("place") <= PIVOTS).select("key", "pivot")


def _moved(joined: DataFrame) -> tuple[DataFrame, Column]:
    """Labels with what they are now, and the column that takes over the new ones."""
    return joined.select(F.col("text").alias("label"), F.col("label").alias("now")), F.coalesce("now", "label").alias("label")


def links_between(key: int, one: list[dict], other: list[dict], threshold: float) -> set[tuple[int, int]]:
    """Linked labels, low and high, of two lists of texts (label, keys, elements) of the bucket
    ``key``. A pair is compared in the bucket of the smallest key that it shares, so once in all."""
    labels = np.array([x["label"] for x in other], np.int64)
    earlier = {}
    for i, x in enumerate(other):
        for k in x["keys"]:
            if k < key:
                earlier.setdefault(k, []).append(i)
    sets = [np.array(x["elements"], np.int32).view(np.uint32) for x in other]
    sketches = [sketch(x) for x in sets]
    found = set()
    for x in one:
        due = labels != x["label"]
        for k in x["keys"]:
            due[earlier.get(k, [])] = False
        open_ = np.flatnonzero(due)
        if not len(open_):
            continue
        own = np.array(x["elements"], np.int32).view(np.uint32)
        for i in open_[may_link(sketch(own), [sketches[i] for i in open_], threshold)]:
            pair = (min(x["label"], int(labels[i])), max(x["label"], int(labels[i])))
            if pair not in found:
                common = len(np.intersect1d(own, sets[i], assume_unique=True))
                if common >= threshold * (len(own) + len(sets[i]) - common):
                    found.add(pair)
    return found


def _links_without_pivot(buckets: DataFrame, sets: DataFrame, labels: DataFrame, threshold: float) -> DataFrame | None:
    """The linked labels (low, high) among the texts that no pivot has compared, or None without such texts.

    Each component with a text in a bucket has a pivot there, and a pivot has met all texts of the
    bucket, so a pair is left only between components with two texts or more in it."""
    placed = buckets.join(labels, "text")
    several = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed_ones = several.groupBy("key").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rest = written(placed.join(several.join(mixed_ones, "key", "left_semi"), ["key", "label"], "left_semi"), "rest")
    if rest.isEmpty():
        return None
    # The sets of texts that share a bucket, not the whole table again.
    used = written(sets.select("text", "elements").join(rest.groupBy("text").agg(F.collect_list("key").alias("keys")), "text"), "compared")
    # A component that fills blocks has its own, which do not meet each other; small ones share blocks.
    parts = (
        rest.join(used.select("text", F.size("elements").alias("size")), "text").groupBy("key", "label").agg(F.sum("size").alias("size"))
        .withColumn("own", F.col("size") >= BLOCK_ELEMENTS).withColumn("of", F.when(F.col("own"), F.col("label")).otherwise(F.lit(0)))
    )
    cut = written(parts.groupBy("key", "own", "of").agg(F.ceil(F.sum("size") / BLOCK_ELEMENTS).alias("blocks")), "cut")
    ids = cut.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), "own", "of").select(
        "key", F.struct("own", "of", "part").alias("id")
    )
    a, b = F.col("a"), F.col("b")
    alone = a["own"] & b["own"] & (a["of"] == b["of"])
    units = ids.withColumnRenamed("id", "a").join(ids.withColumnRenamed("id", "b"), "key").where((a <= b) & ~alone)
    block = F.struct("own", "of", F.pmod(F.xxhash64("text"), F.col("blocks")).alias("part")).alias("id")
    blocks = written(
        rest.join(parts.select("key", "label", "own", "of"), ["key", "label"]).join(cut, ["key", "own", "of"])
        .select("key", "text", "label", block).join(used, "text")
        .groupBy("key", "id").agg(F.collect_list(F.struct("label", "keys", "elements")).alias("texts")),
        "blocks",
    )
    met = (
        units.join(blocks.select("key", F.col("id").alias("a"), F.col("texts").alias("one")), ["key", "a"])
        .join(blocks.select("key", F.col("id").alias("b"), F.col("texts").alias("other")), ["key", "b"]).select("key", "one", "other")
    )

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, one, other = (batch.column(c)[i].as_py() for c in ("key", "one", "other"))
                links = sorted(links_between(key, one, other, threshold))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["low", "high"]
                )

    return written(met.mapInArrow(work, "low long, high long").distinct(), "links")


def components_of_texts(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """text, label of every text (text, bands, elements, sketch) that shares a key with another;
    linked texts share a label."""
    keyed = texts.select("text", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = written(
        keyed.join(shared, "key", "left_semi").select("key", "text", F.col("text").alias("label"), F.lit(True).alias("open")), "buckets"
    )
    sets = written(texts.select("text", "elements", "sketch").join(buckets.select("text").distinct(), "text", "left_semi"), "sets")
    labels = written(sets.select("text", F.col("text").alias("label")), "members")
    shared_buckets, verified, carried = buckets.select("key", "text"), None, []
    while True:
        pivots = written(_pivots(buckets, carried), "pivots")
        # A bucket's few pivots travel as one list, and a text unites the lists of its buckets before
        # pairs are formed: texts that share many buckets with a pivot form the pair once.
        of_bucket = pivots.groupBy("key").agg(F.array_sort(F.collect_list("pivot")).alias("pivots"))
        mates = (
            buckets.join(of_bucket, "key")
            .select("text", "label", *carried, F.filter("pivots", lambda p: p["label"] != F.col("label")).alias("pivots"))
            .where(F.size("pivots") > 0)
        )
        met = (
            (_possible(mates, threshold) if carried else mates).groupBy("text", "label")
            .agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"))
            .select(F.struct("text", "label").alias("own"), F.explode("pivots").alias("pivot"))
        )
        pairs = met.select(F.least("own", "pivot").alias("a"), F.greatest("own", "pivot").alias("b")).distinct().select(
            F.col("a.text").alias("low"), F.col("b.text").alias("high"), F.col("a.label").alias("a"), F.col("b.label").alias("b")
        )
        if verified is not None:
            pairs = pairs.join(verified, ["low", "high"], "left_anti")
        checked = written(_verified(pairs, sets, threshold), "verified")
        done = checked.select("low", "high")
        verified = done if verified is None else verified.unionByName(done)
        # What was joined before is one node by now, so each round's graph is small.
        joined = components(checked.where("linked").select(F.col("a").alias("low"), F.col("b").alias("high")).distinct())
        moved, now = _moved(joined)
        labels = written(labels.join(moved, "label", "left").select("text", now), "members")
        settled = (
            pivots.select("key", F.col("pivot.label").alias("label")).join(moved, "label", "left")
            .groupBy("key").agg(F.collect_set(now).alias("done"))
        )
        # Buckets without a pivot have had no open text, and leave here.
        left = (
            buckets.join(moved, "label", "left").select("key", "text", now, "open", *carried).join(settled, "key")
            .withColumn("open", F.col("open") & ~F.array_contains("done", F.col("label"))).drop("done")
        )
        if not carried:
            left, carried = left.join(sets.select("text", "sketch"), "text"), ["sketch"]
        buckets = written(left.select("key", "text", "label", "open", *carried), "buckets")
        if buckets.where("open").isEmpty():
            break
    found = _links_without_pivot(shared_buckets, sets, labels, threshold)
    if found is None:
        return labels
    moved, now = _moved(components(found))
    return written(labels.join(moved, "label", "left").select("text", now), "members")


def components(edges: DataFrame) -> DataFrame:
    """text, label of every text with an edge (low, high); texts of a component share a label, the
    smallest of them.

    Each round moves every text to its smallest neighbour and contracts the edges, so at least half of
    the texts with edges vanish, and a star of any size takes one round."""
    edges = written(edges.select("low", "high"), "edges")
    nodes = edges.select(F.col("low").alias("text")).union(edges.select(F.col("high").alias("text"))).distinct()
    labels = written(nodes.select("text", F.col("text").alias("label")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("high", "low"))
        parent = written(both.groupBy(F.col("low").alias("label")).agg(F.least(F.col("label"), F.min("high")).alias("now")), "parents")
        labels = written(labels.join(parent, "label", "left").select("text", F.coalesce("now", "label").alias("label")), "labels")
        edges = written(
            edges.join(parent.select(F.col("label").alias("low"), F.col("now").alias("a")), "low")
            .join(parent.select(F.col("label").alias("high"), F.col("now").alias("b")), "high")
            .where("a != b").select(F.col("a").alias("low"), F.col("b").alias("high")).distinct(),
            "edges",
        )
    return labels


def classes(df: DataFrame, id_column: str = "doc_id", text: str = "text", row: str | None = None, threshold: float = THRESHOLD, **signature) -> DataFrame:
    """row, id, class_id (the smallest id of the class), class_size and kept for every row."""
    row_id = F.monotonically_increasing_id() if row is None else F.col(row)
    own = df.select(row_id.alias("row"), F.col(id_column).alias("id"), text_of(text).alias("text"))
    table = written(signed(own, "text", **signature).drop("text"), "signatures")
    first = table.groupBy("digest").agg(F.min("row").alias("text"))
    texts = (
        table.where(F.size("bands") > 0).select("row", "bands", "elements", "sketch")
        .join(first.select(F.col("text").alias("row")), "row", "left_semi").withColumnRenamed("row", "text")
    )
    labels = components_of_texts(texts, threshold)
    rows = written(
        lookup(table.select("row", "id", "digest"), first, "digest").join(labels, "text", "left")
        .select("row", "id", F.coalesce("label", "text").alias("label")),
        "rows",
    )
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    of_class = rows.groupBy("label").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size"))
    return lookup(rows, of_class, "label").select(
        "row", "id", F.col("best.id").alias("class_id"), "class_size", (F.col("best.row") == F.col("row")).alias("kept")
    )
