"""Removal of every byte that a long string occurring twice covers, by families of suffix arrays.

A window is a string of ``LENGTH`` bytes within a text. The place in a window whose hashed run of
``GRAM`` bytes is smallest, the leftmost of equal ones, is its anchor: equal windows have equal anchors,
so equal windows always meet in the shard of their anchor's hash. Neighbouring windows with the
same anchor form a run, and a run with its text is a segment of less than two windows' length.

1. Blocks. Each task packs its texts into blocks and finds the runs; the blocks are written as a table.
2. Anchors. Every block sends the distinct anchor hashes of its runs to shards by hash ranges and
   learns which occur elsewhere; all other windows occur once.
3. Segments. Every block sends its distinct segments with repeated anchors, each once, to the shard of
   the anchor. A shard keeps each distinct segment once: equal ones are repeated as a whole. The
   rest goes, so many whole anchors at a time as fill ``ANCHOR_BYTES``, since equal windows have one anchor, in batches into a
   logarithmic family of suffix arrays: a batch's array, sorted by ranks of
   prefixes that double or triple in length, is merge-scanned with every level for common prefixes of a window's length, and levels of
   like size merge, so each window is sorted again a logarithmic number of times.
   Anchors found in more than ``HOT_BLOCKS`` blocks go another way, exact but for collisions of hashes, so that no
   shard grows with them: each block sends the distinct 128-bit hashes of their windows, dealt out by that hash.
4. Each block marks the bytes under repeated windows and returns its texts without them.

A worker keeps a few bytes for each byte of its block or shard: what takes words for each window (places, hashes, ranks) is
made for at most ``STEP`` windows or ``ANCHOR_BYTES`` at a time, however many of the windows are repeated.

Matches never cross texts; strings are judged on the input. Texts are UTF-8, a null text is empty.
Defined results: texts shorter than a window are kept whole; repeated rows of at least that length
lose all their bytes; null ids are kept as they are; an empty table gives an empty result. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.tables import give_back, slices, text_of, written
from harborline.llm.words import mixed

LENGTH = 200
GRAM = 32
PLACES = LENGTH - GRAM + 1
BLOCK_BYTES = 8 * 1024 * 1024
#: Window starts that are worked on at once.
STEP = 1 << 19
SHARD_ANCHORS = 1_000_000
#: Bytes of text for which there is one segment shard; few shards then need a second batch.
SHARD_BYTES = 4 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024
#: Bytes of segments whose anchors get one family; a single anchor may have more.
ANCHOR_BYTES = 1 << 20
#: Bytes of rows in a row group of the blocks' table, with two rows at least.
GROUP_BYTES = 16 * 1024 * 1024
HOT_BLOCKS = 128

BLOCK = "block long, ids array<long>, lengths array<long>, data binary, n_runs long, starts binary, sizes binary, hashes binary"
RESULT = "id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed)) for seed in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(n, _BASE))
    down = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 2**64))))
    return up, down


_UP, _DOWN = _powers(STEP + LENGTH)


def run_hashes(data: np.ndarray, length: int, letters: np.ndarray) -> np.ndarray:
    """A hash of each run of ``length`` bytes; the data is at most a step and a window long."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[data] * _UP[:n], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * _DOWN[: n - length + 1])


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` neighbours, from the prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    padded = np.concatenate([keys, np.full(-len(keys) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    prefix = np.minimum.accumulate(padded, axis=1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def runs(data: np.ndarray, lengths: np.ndarray):
    """First window, number of windows and the anchor's hash of each run of the windows that lie
    within one text."""
    ends = np.cumsum(lengths)
    found = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), STEP):
        part = data[at : at + STEP + LENGTH - 1]
        grams = run_hashes(part, GRAM, _LETTERS[0])
        keys = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        place = (_smallest(keys, PLACES) & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(len(place), dtype=np.int64)
        text_end = ends[np.searchsorted(ends, start + at, side="right")]
        inside = start + at + LENGTH <= text_end
        start, place = start[inside], place[inside]
        if len(start):
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
            found.append((start[first] + at, np.diff(np.append(first, len(start))), grams[place[first]]))
    if not found:
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)]
    return [np.concatenate(x) for x in zip(*found)]


def _binary(arrays) -> pa.Array:
    return pa.array([a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def _block_row(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    data, lengths = b"".join(texts), np.array([len(t) for t in texts], np.int64)
    starts, sizes, hashes = runs(np.frombuffer(data, np.uint8), lengths)
    # Starts as differences and small numbers in small types compress well.
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
            pa.array([data], pa.binary()), pa.array([len(starts)], pa.int64()),
            _binary([np.diff(starts, prepend=0).astype(np.uint32)]), _binary([sizes.astype(np.uint8)]),
            _binary([hashes]),
        ],
        names=["block", "ids", "lengths", "data", "n_runs", "starts", "sizes", "hashes"],
    )


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            for id_, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                ids.append(id_)
                texts.append(text.encode())
                size += len(texts[-1]) + 1
                if size >= BLOCK_BYTES:
                    yield _block_row(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield _block_row(number, ids, texts)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


ASK = "kind int, part int, shard int, block long, hashes binary, seconds binary, repeated binary, sizes binary, data binary"


def _rows(kind: int, block: int, shards: np.ndarray, total: int, part: int = 0, **columns) -> pa.Table:
    """A row for each shard that occurs in the rising list of shards, with its part of each column.

    A column is an array in step with the list, or a function of the part's bounds."""
    cuts = np.searchsorted(shards, np.arange(total + 1))
    own = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    empty = [b""] * len(own)
    take = lambda c: empty if c is None else [c(a, b) if callable(c) else c[a:b] for _, a, b in own]
    return pa.table({
        "kind": pa.array([kind] * len(own), pa.int32()), "part": pa.array([part] * len(own), pa.int32()), "shard": pa.array([s for s, _, _ in own], pa.int32()),
        "block": pa.array([block] * len(own), pa.int64()),
        **{c: _binary(take(columns.get(c))) for c in ("hashes", "seconds", "repeated", "sizes", "data")},
    })


def ask_anchors(shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes in zip(batch.column("block").to_pylist(), batch.column("hashes").to_pylist()):
                own, counts = np.unique(np.frombuffer(hashes, np.uint64), return_counts=True)
                yield from _rows(1, block, _shard_of(own, shards), shards, hashes=own, repeated=(counts > 1).astype(np.uint8)).to_batches()

    return ask


def _answer_hashes(group: pa.Table) -> list[np.ndarray]:
    """For each list, which is in order: 0 for a hash that occurs once, 1 if it occurs again, 2 if it does in
    more than ``HOT_BLOCKS`` lists. Hashes are worked on by ranges of about ``STEP`` of them."""
    arrays = lambda column, kind: [np.frombuffer(x, kind) for x in group.column(column).to_pylist()]
    firsts, seconds, again = arrays("hashes", np.uint64), arrays("seconds", np.uint64), arrays("repeated", np.uint8)
    out = [np.empty(len(x), np.uint8) for x in firsts]
    filled = [x for x in firsts if len(x)]
    if not filled:
        return out
    low, high = min(int(x[0]) for x in filled), max(int(x[-1]) for x in filled)
    ranges = sum(map(len, filled)) // STEP + 1
    edges = np.array([low + (high - low) * i // ranges for i in range(1, ranges)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in firsts]
    for r in range(ranges):
        parts = [slice(c[r], c[r + 1]) for c in cuts]
        first = np.concatenate([x[p] for x, p in zip(firsts, parts)])
        if not len(first):
            continue
        second = np.concatenate([x[p] if len(x) else np.zeros(p.stop - p.start, np.uint64) for x, p in zip(seconds, parts)])
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        heads = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        member = np.cumsum(heads) - 1
        lists, twice = np.bincount(member), np.bincount(member, weights=np.concatenate([x[p] for x, p in zip(again, parts)])[order])
        code = np.where(lists > HOT_BLOCKS, 2, (lists > 1) | (twice > 0)).astype(np.uint8)
        found = np.empty(len(first), np.uint8)
        found[order] = code[member]
        at = 0
        for x, p in zip(out, parts):
            x[p] = found[at : at + p.stop - p.start]
            at += p.stop - p.start
    return out


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the distinct ones, with a window's length of zeros behind, and their number."""
    order = np.argsort(keys)
    ordered = keys[order]
    heads = np.concatenate([[False], ordered[1:] != ordered[:-1]])
    del ordered
    ranks = np.cumsum(heads, dtype=np.uint32)
    out = np.zeros(len(keys) + LENGTH, np.uint32)
    out[order] = ranks
    return out, int(ranks[-1]) + 1


def _window_ranks(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys that order the windows like their bytes, by ranking ever longer prefixes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH, np.uint8)])
    keys = np.zeros(n, np.uint64)
    for i in range(8):
        keys <<= np.uint64(8)
        keys |= padded[i : i + n]
    length = 8
    while True:
        rank, distinct = _ranked(keys)
        # Three ranks fit a key while there are few of them, else two do.
        parts = 3 if distinct < 1 << 21 else 2
        last = parts * length >= LENGTH
        keys = (rank[starts] if last else rank[:n]).astype(np.uint64)
        for i in range(1, parts):
            keys <<= np.uint64(64 // parts)
            keys |= rank[starts + min(i * length, LENGTH - length)] if last else rank[i * length : i * length + n]
        if last:
            return keys
        length *= parts


class Family:
    """Suffix arrays over the windows of batches, in levels that grow geometrically.

    A level holds each distinct window once, in the order of its bytes. ``repeated`` marks the windows,
    by their numbers, that are equal to another one added before or after."""

    def __init__(self, windows: int, repeated: np.ndarray | None = None):
        self.repeated = np.zeros(windows, bool) if repeated is None else repeated
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _scanned(self, text: np.ndarray, starts: np.ndarray, numbers: np.ndarray):
        keys = _window_ranks(text, starts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.concatenate([[True], keys[1:] != keys[:-1]])
        alone = heads & np.concatenate([heads[1:], [True]])
        self.repeated[numbers[order[~alone]]] = True
        return text, starts[order[heads]], numbers[order[heads]]

    def _together(self, a, b):
        return self._scanned(
            np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + len(a[0])]), np.concatenate([a[2], b[2]])
        )

    def add(self, text: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> None:
        if not len(starts):
            return
        new = self._scanned(text, starts, numbers)
        merged = None
        for level in reversed(self.levels):
            # The last level's scan already is its merge with the batch, if they are of like size.
            both = self._together(level, new)
            if level is self.levels[-1] and len(level[1]) <= 2 * len(new[1]):
                merged = both
        if merged is None:
            self.levels.append(new)
            return
        self.levels[-1] = merged
        while len(self.levels) > 1 and len(self.levels[-2][1]) <= 2 * len(self.levels[-1][1]):
            top = self.levels.pop()
            self.levels[-1] = self._together(self.levels[-1], top)


def _answer_segments(group: pa.Table) -> list[np.ndarray]:
    """For each block's list: one bit for each window of its segments, set if it is repeated."""
    numbers: dict[tuple[int, bytes], int] = {}
    weights, sizes, anchors, members = [], [], [], []
    for hashes, repeated, counts, data in zip(*(group.column(c).to_pylist() for c in ("hashes", "repeated", "sizes", "data"))):
        own, at = [], 0
        for h, again, size in zip(np.frombuffer(hashes, np.uint64).tolist(), repeated, counts):
            text = data[at : at + size + LENGTH - 1]
            at += len(text)
            n = numbers.setdefault((h, text), len(weights))
            if n == len(weights):
                weights.append(0)
                sizes.append(size)
                anchors.append(h)
            weights[n] += 1 + again
            own.append(n)
        members.append(np.array(own, np.int64))
    weights, sizes, anchors = np.array(weights), np.array(sizes, np.int64), np.array(anchors, np.uint64)
    _, inverse, groups = np.unique(anchors, return_inverse=True, return_counts=True)
    first = np.cumsum(sizes) - sizes
    repeated = np.repeat(weights > 1, sizes)
    texts = [t for _, t in numbers]
    shared = np.flatnonzero(groups[inverse] > 1)
    shared = shared[np.argsort(inverse[shared], kind="stable")]
    family, batch, size, held = Family(0, repeated), [], 0, 0
    for i, n in enumerate(shared):
        batch.append(n)
        size += len(texts[n])
        ends = i == len(shared) - 1 or inverse[shared[i + 1]] != inverse[n]
        full = ends and (held + size >= ANCHOR_BYTES or i == len(shared) - 1)
        if size >= BATCH_BYTES or full:
            lengths = np.array([len(texts[n]) for n in batch])
            begin, own = np.cumsum(lengths) - lengths, sizes[batch]
            family.add(np.frombuffer(b"".join(texts[n] for n in batch), np.uint8), _windows(begin, own), _windows(first[batch], own))
            held, batch, size = held + size, [], 0
        if full:
            family, held = Family(0, repeated), 0
    out = []
    for own in members:
        out.append(np.packbits(repeated[_windows(first[own], sizes[own])]))
    return out


def answer(group: pa.Table) -> pa.Table:
    give_back()
    found = _answer_segments(group) if group.column("kind")[0].as_py() == 2 else _answer_hashes(group)
    return pa.table({
        "kind": group.column("kind"), "part": group.column("part"), "block": group.column("block"), "shard": group.column("shard"),
        "found": _binary(found),
    })


ANSWER = "kind int, part int, block long, shard int, found binary"


def _in_order(answers: pa.Table, kind: int, part: int = 0) -> list[np.ndarray]:
    rows = answers.filter(pa.array((answers.column("kind").to_numpy() == kind) & (answers.column("part").to_numpy() == part)))
    pairs = sorted(zip(rows.column("shard").to_pylist(), rows.column("found").to_pylist()), key=lambda x: x[0])
    return [np.frombuffer(x, np.uint8) for _, x in pairs]


class _Known:
    """A block with what it knows of its anchors."""

    def __init__(self, block: pa.Table, answers: pa.Table):
        column = lambda c: block.column(c)[0].as_py()
        self.block, self.ids, self.data = column("block"), column("ids"), column("data")
        self.lengths = np.array(column("lengths"), np.int64)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.starts = np.cumsum(np.frombuffer(column("starts"), np.uint32).astype(np.int64))
        self.sizes = np.frombuffer(column("sizes"), np.uint8).astype(np.int64)
        self.hashes = np.frombuffer(column("hashes"), np.uint64)
        own, inverse = np.unique(self.hashes, return_inverse=True)
        codes = np.concatenate([*_in_order(answers, 1), np.zeros(0, np.uint8)])
        self.code = codes[inverse] if len(own) else codes
        assert len(codes) == len(own)

    def segments(self, shards: int):
        """The runs with repeated anchors; the distinct segments among them in the order of their
        shards; and for each of those runs its segment."""
        at = np.flatnonzero(self.code == 1)
        at = at[np.argsort(_shard_of(mixed(self.hashes[at]), shards), kind="stable")]
        numbers: dict[tuple[int, bytes], int] = {}
        own = np.empty(len(at), np.int64)
        data = self.data
        for i, (h, a, n) in enumerate(zip(self.hashes[at].tolist(), self.starts[at].tolist(), self.sizes[at].tolist())):
            own[i] = numbers.setdefault((h, data[a : a + n + LENGTH - 1]), len(numbers))
        return at, own, numbers

    def hot_parts(self):
        """The windows of hot anchors in parts of whole anchors, as equal windows have one; of each part its windows,
        their distinct hashes in order, for each window its hash, and how many windows have each hash."""
        hot = np.flatnonzero(self.code == 2)
        hot = hot[np.argsort(self.hashes[hot], kind="stable")]
        for at in _parts(hot, self.sizes[hot], self.hashes[hot]):
            sizes = self.sizes[at]
            windows, spans = _windows(self.starts[at], sizes), sizes + LENGTH - 1
            text, own = self.bytes[_windows(self.starts[at], spans)], _windows(np.cumsum(spans) - spans, sizes)
            hashes = np.empty((2, len(windows)), np.uint64)
            for begin in range(0, len(text), STEP):
                a, b = np.searchsorted(own, [begin, begin + STEP])
                if a < b:
                    for side, letters in enumerate(_LETTERS):
                        hashes[side, a:b] = run_hashes(text[begin : begin + STEP + LENGTH - 1], LENGTH, letters)[own[a:b] - begin]
            order = np.lexsort((hashes[1], hashes[0]))
            first, second = hashes[0][order], hashes[1][order]
            heads = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            member = np.empty(len(windows), np.int64)
            member[order] = np.cumsum(heads) - 1
            yield windows, first[heads], second[heads], member, np.bincount(member)


def _windows(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _parts(runs: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None = None) -> list[np.ndarray]:
    """Neighbouring runs of about ``STEP`` windows together; those with equal keys too, up to as many."""
    if not len(runs):
        return []
    before = np.cumsum(sizes) - sizes
    cut = np.diff(before // STEP) > 0
    if keys is not None:
        heads = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = before[heads][np.cumsum(heads) - 1]
        cut = (np.diff(group // STEP) > 0) | (np.diff((before - group) // STEP) > 0)
    return np.split(runs, np.flatnonzero(cut) + 1)


def _covered(marks: np.ndarray) -> np.ndarray:
    """For each byte, whether a marked window lies over it."""
    out = np.empty(len(marks), bool)
    for a in range(0, len(marks), STEP):
        low, b = max(a - LENGTH + 1, 0), min(a + STEP, len(marks))
        sums = np.concatenate([[0], np.cumsum(marks[low:b], dtype=np.int64)])
        place = np.arange(a, b)
        out[a:b] = sums[place + 1 - low] > sums[np.maximum(place - LENGTH + 1, 0) - low]
    return out


def ask_windows(shards: int):
    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        known = _Known(block, answers)
        at, own, numbers = known.segments(shards)
        keys = list(numbers)
        hashes = np.fromiter((h for h, _ in keys), np.uint64, len(keys))
        sizes = np.fromiter((len(t) - LENGTH + 1 for _, t in keys), np.uint8, len(keys))
        again = (np.bincount(own, minlength=len(keys)) > 1).astype(np.uint8)
        segments = _rows(
            2, known.block, _shard_of(mixed(hashes), shards), shards, hashes=hashes, repeated=again, sizes=sizes,
            data=lambda a, b: b"".join(t for _, t in keys[a:b]),
        )
        # A hash in two parts of a block, which is of an anchor that fills several, is in two rows of its shard, as one in two blocks is.
        hot = [
            _rows(3, known.block, _shard_of(first, shards), shards, part, hashes=first, seconds=second, repeated=(counts > 1).astype(np.uint8))
            for part, (_, first, second, _, counts) in enumerate(known.hot_parts())
        ]
        return pa.concat_tables([segments, *hot])

    return ask


def without_repeats(shards: int):
    def cut(block: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        known = _Known(block, answers)
        at, own, numbers = known.segments(shards)
        sizes = np.fromiter((len(t) - LENGTH + 1 for _, t in numbers), np.int64, len(numbers))
        # A shard packs the bits of its segments from a byte on.
        cuts = np.searchsorted(_shard_of(mixed(np.fromiter((h for h, _ in numbers), np.uint64, len(numbers))), shards), np.arange(shards + 1))
        bits = [
            np.unpackbits(x, count=int(sizes[a:b].sum()))
            for x, (a, b) in zip(_in_order(answers, 2), ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b))
        ]
        flags = np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)
        first = np.cumsum(sizes) - sizes
        marks = np.zeros(len(known.bytes), bool)
        for part in _parts(np.arange(len(at)), known.sizes[at]):
            windows = _windows(known.starts[at[part]], known.sizes[at[part]])
            marks[windows[flags[_windows(first[own[part]], sizes[own[part]])]]] = True
        for part, (windows, _, _, member, _) in enumerate(known.hot_parts()):
            marks[windows[np.concatenate(_in_order(answers, 3, part))[member] > 0]] = True
        removed = _covered(marks)
        ends = np.cumsum(known.lengths)
        rows = {"starts": [], "ends": [], "kept": [], "n_removed": []}
        for a, b in zip(ends - known.lengths, ends):
            mask = removed[a:b]
            n = int(mask.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if n else np.zeros(0, np.int64)
            rows["starts"].append(edges[::2])
            rows["ends"].append(edges[1::2])
            rows["n_removed"].append(n)
            rows["kept"].append(known.bytes[a:b][~mask].tobytes() if n else known.data[a:b])
        return pa.table({
            "id": pa.array(known.ids, pa.int64()), "n_bytes": pa.array(known.lengths), "n_removed": pa.array(rows["n_removed"], pa.int64()),
            "starts": pa.array(rows["starts"], pa.list_(pa.int64())), "ends": pa.array(rows["ends"], pa.list_(pa.int64())),
            "kept": pa.array(rows["kept"], pa.binary()),
        })

    return cut


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, the removed spans' starts and ends, and the kept bytes of every row."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), text_of(text).alias("text"))
    # Else a row group is a hundred rows or more of a block each, which a task writes and reads in memory.
    table = written(rows.mapInArrow(packed, BLOCK), "blocks", **{"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 2})
    sums = table.select(F.sum("n_runs").alias("runs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("bytes")).first()
    if sums.runs is None:
        return df.sparkSession.createDataFrame([], RESULT)
    anchor_shards = sums.runs // SHARD_ANCHORS + 1
    anchors = written(
        table.select("block", "hashes").mapInArrow(ask_anchors(anchor_shards), ASK)
        .groupBy("shard").applyInArrow(answer, ANSWER),
        "anchors",
    )
    shards = sums.bytes // SHARD_BYTES + 1
    texts = table.select("block", "ids", "lengths", "data", "starts", "sizes", "hashes")
    asked = texts.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(ask_windows(shards), ASK)
    answers = asked.groupBy("kind", "shard").applyInArrow(answer, ANSWER)
    return texts.groupBy("block").cogroup(anchors.unionByName(answers).groupBy("block")).applyInArrow(without_repeats(shards), RESULT)
