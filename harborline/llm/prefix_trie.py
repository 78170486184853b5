"""Prefix trie of conversations, rolled up by centroid decomposition.

1. Order. Turns become narrow rows: two lanes of a digest of role and text, and the text's bytes; texts
   don't move. The rows are range-partitioned and sorted by conversation and turn, and a stream over each
   partition numbers them. One row a partition carries the state of a conversation that goes on in the
   next one, so a conversation of any length spreads over tasks.
2. Rebuilding. A conversation borrows the first turns of another by an equality join (eight at most), and its own
   other turns follow. The same ordered stream gives each turn its depth and a rolling hash of the turns
   up to it (two lanes of 64 bits, wrapping multiplication by odd numbers, combined over partitions).
3. Nodes. Rows are grouped by depth and prefix hash. A node's weight is its number of members; the sum of
   the weights below a node is the sum of its members' remaining lengths, so it is known before any rollup.
4. Centroids. The edges to the parents form a forest of one tree. Each round takes in every component above
   ``bound`` the deepest node with more than half the component's weight, adds the component's total at and
   below it to all nodes on the way from it to the component's top, and removes it. What lies below each
   of its children and the rest above are new components of at most half the weight. A node is below the
   centroid if its smallest member's prefix at the centroid's depth is the centroid: one equality join. Rounds
   grow with the logarithm of the turns, however deep the trie. Components within the bound go on the
   same way inside one task each. Fewer than turns / bound components are large, and the bound is at least
   a hundred-thousandth of all turns, so the broadcast list of large ones stays below 100,000 rows.
5. Ends. The ids of the conversations that end at a node are range-partitioned by node and id, joined into
   pieces, and each node's pieces are streamed through one digest, a piece at a time.

Nodes are told apart by depth and 128 bits of hash. Joins on hot prefixes are left to adaptive execution.

Defined results: rows without conv_id belong to no conversation. Rows of a conversation with the same turn
are ordered by a digest of role and text. A null role or text is empty. Repeated rows are turns of their
own. c - c % 5 is the multiple of five at or below c. An empty table has no nodes, not even a root. Columns
other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.tables import text_of, written

#: The heads have at most this many turns.
MOST_BORROWED = 8
#: Weight up to which a component is taken apart inside one task.
BOUND = 50_000
LEAST_SHARE = 100_000
#: Conversation ids in one piece of a node's list.
PIECE_IDS = 8192

#: The odd multipliers of the two lanes of a prefix hash.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MASK = 2**64 - 1
NODE = ["depth", "a", "b"]
SEQUENCE = "part int, conv_id long, depth long, a long, b long, pa long, pb long, x long, y long, bytes long"


def turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, x, y, bytes: the turns, with two lanes of a digest in place of role and text."""
    role, text = text_of("role"), text_of("text")
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"), 256)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", _lane("digest", 1).alias("x"), _lane("digest", 16).alias("y"), "bytes"
    )


def _lane(digest: str, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


def _in_sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted turns of a partition and hashes their prefixes, as if each conversation
    began in this partition."""
    part = TaskContext.get().partitionId()
    conv, depth, state = None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        starts = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        place = np.arange(n) - starts[of]
        goes_on = conv == ids[0]
        depths = place + 1 + np.where((of == 0) & goes_on, depth, 0)
        lanes, before = [], []
        for k, name in enumerate(("x", "y")):
            base, inverse = BASES[k], pow(BASES[k], -1, 2**64)
            up, down = _powers(base, n), _powers(inverse, n)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_unsigned(batch.column(name)) + np.uint64(1)) * down[1:])])
            # H = sum of x_j * base^(last - j) over the conversation's turns in this batch
            lane = (sums[1:] - sums[starts[of]]) * up[1:]
            if goes_on:
                head = of == 0
                lane[head] += np.uint64(state[k]) * up[1:][head]
            previous = np.zeros(n, np.uint64)
            previous[1:] = lane[:-1]
            previous[starts] = 0
            if goes_on:
                previous[0] = state[k]
            lanes.append(lane)
            before.append(previous)
        conv, depth, state = ids[-1], int(depths[-1]), [int(lane[-1]) for lane in lanes]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, part, np.int32)), batch.column("conv_id"), pa.array(depths.astype(np.int64)),
                *map(_signed, lanes), *map(_signed, before), batch.column("x"), batch.column("y"), batch.column("bytes"),
            ],
            names=["part", "conv_id", "depth", "a", "b", "pa", "pb", "x", "y", "bytes"],
        )


def _carried(table: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """For each partition whose first conversation began before: its id, depth and hashes so far.
    One row a partition comes to the driver."""
    rows = table.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "a", "b")).alias("last")).collect()
    carried, state = {}, None
    for row in sorted(rows, key=lambda r: r.part):
        if state is not None and state[0] == row.first:
            carried[row.part] = state
        last = (row.last.conv_id, row.last.depth, row.last.a & MASK, row.last.b & MASK)
        if row.part in carried and row.last.conv_id == row.first:
            conv, depth, *lanes = state
            a, b = ((h * pow(base, last[1], 2**64) + own) & MASK for h, base, own in zip(lanes, BASES, last[2:]))
            last = (conv, depth + last[1], a, b)
        state = last
    return carried


def _continued(carried: dict[int, tuple[int, int, int, int]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            parts, ids = columns["part"].to_numpy(), columns["conv_id"].to_numpy()
            depth = columns["depth"].to_numpy().copy()
            lanes = {c: _unsigned(columns[c]).copy() for c in ("a", "b", "pa", "pb")}
            for part in np.unique(parts):
                state = carried.get(int(part))
                if state is None:
                    continue
                at = np.flatnonzero((parts == part) & (ids == state[0]))
                if not len(at):
                    continue
                own = depth[at]
                for k, (now, before) in enumerate((("a", "pa"), ("b", "pb"))):
                    power = _powers(BASES[k], int(own.max()))
                    lanes[now][at] += np.uint64(state[2 + k]) * power[own]
                    lanes[before][at] += np.uint64(state[2 + k]) * power[own - 1]
                depth[at] = own + state[1]
            columns |= {"depth": pa.array(depth)} | {c: _signed(v) for c, v in lanes.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return work


def sequenced(df: DataFrame, *order: str) -> DataFrame:
    """Numbers the rows of each conversation from 1 (``depth``) in the given order, and adds the hashes
    of the prefixes that end with the row (a, b) and with the row before (pa, pb)."""
    ordered = df.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    table = written(ordered.select("conv_id", "x", "y", "bytes").mapInArrow(_in_sequence, SEQUENCE), "in-sequence")
    carried = _carried(table)
    return written(table.mapInArrow(_continued(carried), SEQUENCE), "sequence") if carried else table


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids of all conversations, and the sequence of their rebuilt turns."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)
    convs = own.where("depth = 1").select("conv_id", head.alias("h"))
    lender = own.where(F.col("depth") <= MOST_BORROWED).select(F.col("conv_id").alias("lender"), "depth", "x", "y", "bytes")
    borrowers = convs.withColumn("lender", F.col("conv_id") - F.pmod("conv_id", F.lit(5).cast("long")))
    borrowed = borrowers.join(lender, "lender").where(F.col("depth") <= F.col("h"))
    columns = ["conv_id", "depth", "x", "y", "bytes"]
    rows = borrowed.select(F.lit(0).alias("own"), *columns).unionByName(
        own.where(F.col("depth") > head).select(F.lit(1).alias("own"), *columns)
    )
    rows = written(rows.withColumnRenamed("depth", "place"), "rebuilt")
    return convs.select("conv_id"), sequenced(rows, "own", "place")


def nodes(convs: DataFrame, sequence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and the node at which each conversation ends."""
    lasts = sequence.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("last"))
    zero = F.lit(0).cast("long")
    ends = written(
        convs.join(lasts, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"last.{c}"), zero).alias(c) for c in NODE)), "ends"
    )
    lengths = ends.select("conv_id", F.col("depth").alias("length"))
    members = F.count(F.lit(1)).alias("n_convs")
    inner = sequence.join(lengths, "conv_id").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), members, F.sum(F.col("length") - F.col("depth") + 1).alias("below"),
        F.min("bytes").alias("bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    )
    root = ends.agg(F.min("conv_id").alias("conv_id"), members, F.sum(F.col("depth") + 1).alias("below")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in NODE), "conv_id", "n_convs", "below", *(zero.alias(c) for c in ("bytes", "pa", "pb")))
    found = written(inner.unionByName(root), "nodes")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    of = found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    return written(of, "nodes"), ends


STATE = ["td", "ta", "tb", *NODE, "conv_id", "pa", "pb", "below", "leaves", "saved"]
TOP = ["td", "ta", "tb"]
#: The centroid of a component.
CENTROID = ["cd", "ca", "cb"]


def _is(left: list[str], right: list[str]) -> Column:
    (a, x), (b, y), (c, z) = zip(left, right)
    return (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)) & (F.col(c) == F.col(z))


def _round(active: DataFrame, sequence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes the centroid of every component of ``active``; the rows have the weight of their
    component. Returns the remaining rows and what is added to nodes."""
    heavy = active.where(2 * F.col("below") > F.col("weight"))
    chosen = written(
        heavy.groupBy(*TOP).agg(F.max(F.struct(*NODE, "conv_id", "below")).alias("c")).select(
            *TOP, F.col("c.depth").alias("cd"), F.col("c.a").alias("ca"), F.col("c.b").alias("cb"),
            F.col("c.conv_id").alias("c_conv"), F.col("c.below").alias("c_below"),
        ),
        "centroids",
    )
    # The row one deeper than the centroid names both the child below it and the prefix at its depth.
    at = sequence.select("conv_id", (F.col("depth") - 1).alias("cd"), F.col("a").alias("child_a"), F.col("b").alias("child_b"), F.col("pa").alias("at_a"), F.col("pb").alias("at_b"))
    below = (F.col("depth") > F.col("cd")) & F.coalesce((F.col("at_a") == F.col("ca")) & (F.col("at_b") == F.col("cb")), F.lit(False))
    placed = written(
        active.join(F.broadcast(chosen), TOP).join(at, ["conv_id", "cd"], "left")
        .withColumn("is_below", below).withColumn("is_centroid", _is(NODE, CENTROID)),
        "placed",
    )
    totals = placed.where("is_below OR is_centroid").groupBy(*TOP).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    way = sequence.join(F.broadcast(chosen.withColumnRenamed("c_conv", "conv_id")), "conv_id").where("depth BETWEEN td AND cd").select(*TOP, *NODE, "cd", "c_below")
    from_root = chosen.where("td = 0").select(*TOP, *(F.lit(0).cast("long").alias(c) for c in NODE), "cd", "c_below")
    way = written(way.unionByName(from_root).join(F.broadcast(totals), TOP), "ways")
    lessened = way.where("depth < cd").select(*NODE, F.col("c_below").alias("less"))
    above = placed.where("NOT is_below AND NOT is_centroid").select(*STATE).join(lessened, NODE, "left")
    above = above.withColumn("below", F.col("below") - F.coalesce("less", F.lit(0).cast("long"))).select(*STATE)
    under = placed.where("is_below").withColumns({"td": F.col("cd") + 1, "ta": F.col("child_a"), "tb": F.col("child_b")}).select(*STATE)
    return written(above.unionByName(under), "components"), way.select(*NODE, "leaves", "saved")


def taken_apart(parents: list[int], below: list[int], leaves: list[int], saved: list[int]) -> tuple[list[int], list[int]]:
    """The sums of leaves and saved over the subtree of each node of one component, by centroid
    decomposition. Node 0 is the top; a parent stands before its children."""
    n = len(parents)
    below, children = list(below), [[] for _ in range(n)]
    for v in range(1, n):
        children[parents[v]].append(v)
    of_leaves, of_saved = [0] * n, [0] * n
    tops = [0]
    while tops:
        top = tops.pop()
        half, c = below[top] / 2, top
        while (deeper := next((k for k in children[c] if below[k] > half), None)) is not None:
            c = deeper
        total_leaves = total_saved = 0
        todo = [c]
        while todo:
            v = todo.pop()
            total_leaves += leaves[v]
            total_saved += saved[v]
            todo += children[v]
        of_leaves[c] += total_leaves
        of_saved[c] += total_saved
        v = c
        while v != top:
            v = parents[v]
            of_leaves[v] += total_leaves
            of_saved[v] += total_saved
            below[v] -= below[c]
        tops += children[c]
        if c != top:
            children[parents[c]].remove(c)
            tops.append(top)
        children[c] = []
    return of_leaves, of_saved


SUMS = "depth long, a long, b long, leaves long, saved long"


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes apart the components that follow each other in the sorted rows."""
    top, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        place = {}
        parents = []
        for depth, a, b, pa_, pb, *_ in held:
            parents.append(place.get((depth - 1, pa_, pb), -1))
            place[(depth, a, b)] = len(place)
        sums = taken_apart(parents, [r[5] for r in held], [r[6] for r in held], [r[7] for r in held])
        return [(*r[:3], x, y) for r, x, y in zip(held, *sums)]

    out = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*TOP, *NODE, "pa", "pb", "below", "leaves", "saved"))):
            if row[:3] != top:
                if held:
                    out += done()
                top, held = row[:3], []
                if len(out) >= 50_000:
                    yield _rows(out)
                    out = []
            held.append(row[3:])
    if held:
        out += done()
    if out:
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[*NODE, "leaves", "saved"])


def rolled_up(trie: DataFrame, sequence: DataFrame, bound: int = BOUND) -> DataFrame:
    """depth, a, b, leaves and saved: the sums over each node's subtree."""
    zero = F.lit(0).cast("long")
    state = trie.select(
        *(zero.alias(c) for c in TOP), *NODE, "conv_id", "pa", "pb", "below",
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    root = trie.where("depth = 0").select("below").first()
    bound = max(bound, (root.below if root else 0) // LEAST_SHARE)
    small, added = [], []
    while True:
        large = written(state.where(_is(NODE, TOP) & (F.col("below") > bound)).select(*TOP, F.col("below").alias("weight")), "large")
        if large.isEmpty():
            small.append(state)
            break
        small.append(state.join(F.broadcast(large.select(*TOP)), TOP, "left_anti"))
        state, adds = _round(state.join(F.broadcast(large), TOP), sequence)
        added.append(adds)
    rest = small[0]
    for rows in small[1:]:
        rest = rest.unionByName(rows)
    sums = rest.repartition(*TOP).sortWithinPartitions(*TOP, "depth").mapInArrow(_apart, SUMS)
    for rows in added:
        sums = sums.unionByName(rows)
    return sums.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of rows of one node, as node and (key, value) rows, batch by batch."""
    for batch in batches:
        nodes_ = zip(*(batch.column(c).to_pylist() for c in NODE))
        yield from zip(nodes_, *(batch.column(i).to_pylist() for i in range(3, batch.num_columns)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the sorted ids of a node into pieces of bounded length."""
    node, ids, out = None, [], []

    def flushed() -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out))
        arrays = [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[*NODE, "first", "piece"])

    size = 0
    for key, id_ in _runs(batches):
        if key != node or len(ids) >= PIECE_IDS:
            flushed()
            size += len(ids)
            node, ids = key, []
            if size >= 8 * PIECE_IDS:
                yield batch_of()
                out, size = [], 0
        ids.append(id_)
    flushed()
    if out:
        yield batch_of()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest, out = None, None, []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])

    for key, _, piece in _runs(batches):
        if key == node:
            digest.update(b",")
        else:
            if node is not None:
                out.append((*node, digest.hexdigest()))
                if len(out) >= 50_000:
                    yield batch_of()
                    out = []
            node, digest = key, hashlib.sha256()
        digest.update(piece.encode())
    if node is not None:
        out.append((*node, digest.hexdigest()))
        yield batch_of()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of the nodes at which conversations end."""
    ordered = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = ordered.mapInArrow(_pieces, "depth long, a long, b long, first long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def trie_nodes(df: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row for each node of the trie over the rebuilt conversations."""
    own = sequenced(written(turns(df), "turns"), "turn", "x", "y")
    convs, sequence = rebuilt(own)
    trie, ends = nodes(convs, sequence)
    sums = rolled_up(trie, sequence, bound)
    parents = trie.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    rows = trie.join(sums, NODE).join(end_digests(ends), NODE, "left")
    return rows.join(parents, ["depth", "pa", "pb"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
