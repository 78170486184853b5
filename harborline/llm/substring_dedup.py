"""Removal of repeated passages of words by suffix automata of reference shards.

A window is ``LENGTH`` consecutive words of one document. A word is removed if a window over it also
starts earlier: in a document of a smaller id, or earlier in the same document.

1. Blocks. Each task packs its documents, as words joined by blanks, into blocks; they are written as a
   table bucketed by block, so later joins on the block never move texts again.
2. Anchors. The least hashed run of ``GRAM`` words in a window, the leftmost of equal ones, is its anchor. Equal
   windows have equal anchors. Every block sends its distinct anchors to shards by hash ranges and learns
   which occur elsewhere; windows of the others occur once.
3. First places. Every block sends, for each distinct window with a repeated anchor, a hash and its first
   place in the block to the shard of the anchor; the shard answers where each window occurs first.
   So a passage goes out once a block, however often the block repeats it. This finds candidates only.
4. Reference shards. The distinct passages that hold first places are cut out of their blocks, each once, and joined
   to the blocks that may repeat them: they are the reference shard of that block, and a passage
   that many documents repeat is thereby broadcast to just the blocks in need of it (an ordinary join, whose hot
   passages adaptive execution splits).
5. Automata. A block builds suffix automata over its reference shard, at most ``REFERENCE_WORDS`` words at a time,
   in the order of the documents, so each state knows its first place. It streams its documents through them
   for matching statistics, capped at the window's length: where a match is that long and its first place is earlier,
   the window is marked. Words are compared as bytes here, so no hash decides a removal. Marked words form
   the maximal spans that are removed.

Windows are judged on the input. Words are runs of characters other than blank and U+0009 to U+000D.

Defined results: a null text has no words. A null id is smaller than every other. Rows with the same id are different
documents; the one that comes first in the written blocks counts as earlier. Documents shorter than a
window are kept whole. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.tables import bucketed, slices, text_of, written
from harborline.llm.words import mixed

LENGTH = 20
GRAM = 8
PLACES = LENGTH - GRAM + 1
BLOCK_BYTES = 1024 * 1024
#: Windows that are worked on at once, and bytes that are hashed at once.
STEP = 1 << 20
HASHED_BYTES = 1 << 18
#: Anchors in a shard, and words in all for which one shard is made.
SHARD_WORDS = 1_000_000
#: Words in one automaton, and windows in one piece.
REFERENCE_WORDS = 20_000
PIECE_WINDOWS = 10_000

BLOCK = "block long, ids array<long>, data binary, n_words long"
RESULT = "id long, n_words long, n_removed long, starts array<long>, ends array<long>, kept string"
ANCHORS = "shard int, block long, anchors binary, several binary"
WINDOWS = "shard int, block long, ids binary, places binary, sizes binary, width int, steps binary, hashes binary"
FIRSTS = "block long, places binary, sizes binary, t_blocks binary, t_places binary, t_ids binary"
#: One row a block with its pieces (word, windows, t_block, t_place, bytes, t_id as numbers), and one for each
#: passage that it asks another block for.
PIECES = "block long, pieces binary, t_block long, t_place long, bytes long"

PASSAGES = "t_block long, t_place long, bytes long, passage binary"

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_LETTERS = mixed(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_BASE = 0xAF251AF3B0F025B5
LEAST_ID = -(2**63)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, lines, size, words = [], [], 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"\n".join(lines)], pa.binary()), pa.array([words], pa.int64())],
            names=["block", "ids", "data", "n_words"],
        )

    for batch in batches:
        for part in slices(batch, "text"):
            for id_, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                own = text.encode().split()  # bytes: blank and U+0009 to U+000D only
                ids.append(id_)
                lines.append(b" ".join(own))
                words += len(own)
                size += len(lines[-1]) + 1
                if size >= BLOCK_BYTES:
                    yield row()
                    number += 1
                    ids, lines, size, words = [], [], 0, 0
    if ids:
        yield row()


def blocks(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    rows = df.select(F.col(id_column).cast("long").alias("id"), text_of(text).alias("text"))
    return bucketed(rows.mapInArrow(_packed, BLOCK), "passages", "block")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP = np.cumprod(np.full(n, U64(_BASE)))
        _DOWN = np.cumprod(np.full(n, U64(pow(_BASE, -1, 2**64))))
    return _UP, _DOWN


_UP = _DOWN = np.zeros(0, U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASHED_BYTES, side="right")))
        a, b = starts[i], ends[j - 1]
        up, down = _powers(max(b - a, HASHED_BYTES))
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(_LETTERS[data[a:b]] * up[: b - a], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return mixed(out + (ends - starts).astype(U64) * _GOLDEN)


class Scan:
    """The words and windows of a block: where words start and end, their line, hashed runs of words."""

    def __init__(self, data: bytes):
        octets = np.frombuffer(data, np.uint8)
        edge = np.diff(((octets != 32) & (octets != 10)).astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.line = np.searchsorted(np.flatnonzero(octets == 10), self.starts)
        n = max(len(self.starts) - LENGTH + 1, 0)
        self.inside = self.line[: n] == self.line[LENGTH - 1 :] if n else np.zeros(0, bool)
        hashes = word_hashes(octets, self.starts, self.ends)
        grams = np.zeros(max(len(hashes) - GRAM + 1, 0), U64)
        for j in range(GRAM):
            grams = grams * _GOLDEN + hashes[j : j + len(grams)]
        self.grams = mixed(grams)
        self.n = n

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each window."""
        g, n = self.grams, self.n
        return mixed((g[:n] * _GOLDEN + g[GRAM : GRAM + n]) * _GOLDEN + g[LENGTH - GRAM :][:n])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and the anchor's hash of the runs of windows that share an anchor's place."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))]
        for at in range(0, self.n, STEP):
            grams = self.grams[at : at + STEP + PLACES - 1]
            keys = (grams >> U64(24) << U64(24)) | np.arange(len(grams), dtype=U64)
            least, width = keys, 1
            while width < PLACES:
                step = min(width, PLACES - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            place = (least & U64(0xFFFFFF)).astype(np.int64)
            start = np.flatnonzero(self.inside[at : at + STEP])
            place = place[start]
            if len(start):
                first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
                found.append((start[first] + at, np.diff(np.append(first, len(start))), grams[place[first]]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _binary(arrays) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def _expanded(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run."""
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first, sizes) + at


def ask_anchors(shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, data = batch.column("block")[i].as_py(), batch.column("data")[i].as_py()
                anchors, counts = np.unique(Scan(data).runs()[2], return_counts=True)
                cuts = np.searchsorted(_shard_of(anchors, shards), np.arange(shards + 1))
                own = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _, _ in own], pa.int32()), pa.array([block] * len(own), pa.int64()),
                        _binary(anchors[a:b] for _, a, b in own), _binary(np.packbits(counts[a:b] > 1) for _, a, b in own),
                    ],
                    names=["shard", "block", "anchors", "several"],
                )

    return ask


def answer_anchors(group: pa.Table) -> pa.Table:
    """One bit for each anchor of a block: whether it occurs elsewhere too."""
    asked = [np.frombuffer(x, U64) for x in group.column("anchors").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)) for a, x in zip(asked, group.column("several").to_pylist())]
    _, of, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    counts += np.bincount(of, np.concatenate(several), minlength=len(counts)).astype(np.int64)
    bits = np.split((counts > 1)[of], np.cumsum([len(a) for a in asked])[:-1])
    return pa.table({"block": group.column("block"), "shard": group.column("shard"), "bits": _binary(map(np.packbits, bits)), "n": pa.array([len(a) for a in asked], pa.int32())})


def _ids(block: pa.Table) -> np.ndarray:
    """The documents' ids, in the order of the block; null as the least."""
    return np.array([LEAST_ID if i is None else i for i in block.column("ids")[0].as_py()], np.int64)


def _first_of(scan: Scan, ids: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each window the earliest window of the block with the same hash."""
    order = np.lexsort((at, ids[scan.line[at]]))
    _, first, of = np.unique(hashes[at][order], return_index=True, return_inverse=True)
    out = np.empty(len(at), np.int64)
    out[order] = at[order][first][of]
    return out


def ask_windows(shards: int):
    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        number, scan, ids = block.column("block")[0].as_py(), Scan(block.column("data")[0].as_py()), _ids(block)
        first, sizes, anchors = scan.runs()
        distinct, of = np.unique(anchors, return_inverse=True)
        by_shard = sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "bits", "n"))), key=lambda x: x[0])
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, b, n in by_shard]
        repeated = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)[of] if len(distinct) else np.zeros(0, bool)
        first, sizes, anchors = first[repeated], sizes[repeated], anchors[repeated]
        at, run = _expanded(first, sizes), np.repeat(np.arange(len(first)), sizes)
        hashes = scan.hashes()
        own = _first_of(scan, ids, at, hashes) == at
        at, run = at[own], run[own]
        shard = _shard_of(anchors, shards)[run]
        order = np.lexsort((at, shard))
        at, run, shard = at[order], run[order], shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        rows = []
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                places, runs = at[a:b], run[a:b]
                new = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1] + 1) | (runs[1:] != runs[:-1])]))
                steps = scan.starts[places + 1] - scan.starts[places]
                kind = np.uint8 if steps.max() < 256 else np.uint32
                rows.append((
                    s, ids[scan.line[places[new]]], scan.starts[places[new]].astype(np.uint32),
                    np.diff(np.append(new, b - a)).astype(np.uint8), steps.astype(kind), hashes[places],
                ))
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([number] * len(rows), pa.int64()),
            "ids": _binary(r[1] for r in rows), "places": _binary(r[2] for r in rows), "sizes": _binary(r[3] for r in rows),
            "width": pa.array([r[4].itemsize for r in rows], pa.int32()), "steps": _binary(r[4] for r in rows), "hashes": _binary(r[5] for r in rows),
        })

    return ask


def answer_windows(group: pa.Table) -> pa.Table:
    """For each window that occurs earlier in another block: where it occurs first, in runs."""
    columns = [group.column(c).to_pylist() for c in ("block", "ids", "places", "sizes", "width", "steps", "hashes")]
    parts = []
    for block, ids, places, sizes, width, steps, hashes in zip(*columns):
        ids = np.frombuffer(ids, np.int64)
        parts.append((
            np.full(len(ids), block, np.int64), ids, np.frombuffer(places, np.uint32).astype(np.int64), np.frombuffer(sizes, np.uint8).astype(np.int64),
            np.frombuffer(steps, np.uint8 if width == 1 else np.uint32).astype(np.int64), np.frombuffer(hashes, U64),
        ))
    blocks_, ids, places, sizes, steps, hashes = (np.concatenate(x) for x in zip(*parts))
    # the place of each window: its run's place and the steps before it
    before = np.cumsum(steps) - steps
    head = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(sizes)), sizes)
    place = places[run] + before - before[head][run]
    order = np.lexsort((places, blocks_, ids))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((place, rank[run], hashes))
    ranked = hashes[by]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    target = np.empty(len(by), np.int64)
    target[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.flatnonzero(target != np.arange(len(target)))
    if not len(late):
        return _firsts([])
    mine, other = run[late], target[late]
    new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (late[1:] != late[:-1] + 1) | (other[1:] != other[:-1] + 1) | (run[other[1:]] != run[other[:-1]])])
    new = np.flatnonzero(new)
    n = np.diff(np.append(new, len(late)))
    mine, other = mine[new], other[new]
    of = blocks_[mine]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
    own = place[late[new]]
    return _firsts([
        (of[a], own[a:b], n[a:b], blocks_[run[other[a:b]]], place[other[a:b]], ids[run[other[a:b]]]) for a, b in zip(cut, cut[1:])
    ])


def _firsts(rows: list[tuple]) -> pa.Table:
    kinds = (np.uint32, np.uint8, np.int64, np.uint32, np.int64)
    columns = [_binary(r[i + 1].astype(k) for r in rows) for i, k in enumerate(kinds)]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), *columns], names=["block", "places", "sizes", "t_blocks", "t_places", "t_ids"])


def find_pieces(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The runs of windows of a block that have, as far as hashes tell, an earlier place, with the place."""
    number, scan, ids = block.column("block")[0].as_py(), Scan(block.column("data")[0].as_py()), _ids(block)
    t_block, t_place, t_id = np.full(scan.n, -1, np.int64), np.zeros(scan.n, np.int64), np.zeros(scan.n, np.int64)
    for row in zip(*(answers.column(c).to_pylist() for c in ("places", "sizes", "t_blocks", "t_places", "t_ids"))):
        places, sizes, blocks_, firsts, first_ids = (np.frombuffer(x, k).astype(np.int64) for x, k in zip(row, (np.uint32, np.uint8, np.int64, np.uint32, np.int64)))
        head = np.searchsorted(scan.starts, places)
        at = _expanded(head, sizes)
        t_block[at], t_id[at] = np.repeat(blocks_, sizes), np.repeat(first_ids, sizes)
        t_place[at] = np.repeat(firsts - scan.starts[head], sizes) + scan.starts[at]  # equal words, equal distances
    at = np.flatnonzero(scan.inside)
    first = _first_of(scan, ids, at, scan.hashes())
    later = at != first
    local, first = at[later], first[later]
    elsewhere = t_block[first] >= 0
    t_block[local] = np.where(elsewhere, t_block[first], number)
    t_place[local] = np.where(elsewhere, t_place[first], scan.starts[first])
    t_id[local] = np.where(elsewhere, t_id[first], ids[scan.line[first]])
    at = np.flatnonzero(t_block >= 0)
    shift = t_place[at] - scan.starts[at]
    line = scan.line[at]
    change = (at[1:] != at[:-1] + 1) | (line[1:] != line[:-1]) | (t_block[at[1:]] != t_block[at[:-1]]) | (shift[1:] != shift[:-1]) | (t_id[at[1:]] != t_id[at[:-1]])
    new = np.flatnonzero(np.concatenate([[True], change])) if len(at) else np.zeros(0, np.int64)
    first, sizes = at[new], np.diff(np.append(new, len(at)))
    parts = -(-sizes // PIECE_WINDOWS)
    of = np.repeat(np.arange(len(first)), parts)
    skipped = PIECE_WINDOWS * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    word, windows = first[of] + skipped, np.minimum(sizes[of] - skipped, PIECE_WINDOWS)
    size = scan.ends[word + windows + LENGTH - 2] - scan.starts[word] if len(word) else word
    pieces = np.stack([word, windows, t_block[word], t_place[word], size, t_id[word]], axis=1).astype(np.int64)
    asked = np.unique(pieces[pieces[:, 2] != number][:, 2:5], axis=0)
    none = [None] * len(asked)
    return pa.table([
        pa.array([number] * (1 + len(asked)), pa.int64()), pa.array([pieces.tobytes(), *none], pa.binary()),
        *(pa.array([None, *asked[:, i].tolist()], pa.int64()) for i in range(3)),
    ], names=["block", "pieces", "t_block", "t_place", "bytes"])


def cut_passages(block: pa.Table, asked: pa.Table) -> pa.Table:
    """The distinct passages that other blocks ask of a block."""
    data = block.column("data")[0].as_py()
    places, sizes = asked.column("t_place"), asked.column("bytes")
    cut = [data[a : a + n] for a, n in zip(places.to_pylist(), sizes.to_pylist())]
    return pa.table([asked.column("t_block"), places, sizes, pa.array(cut, pa.binary())], names=["t_block", "t_place", "bytes", "passage"])


class SuffixAutomaton:
    """The suffix automaton of passages of words; every state knows where its strings first end.

    Passages are set apart by numbers, which equal no word."""

    def __init__(self, passages: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        next_, link, size, first = self.next, self.link, self.size, self.first
        last = end = 0
        for words in passages:
            for word in (*words, end):
                state = len(next_)
                next_.append({})
                link.append(0)
                size.append(size[last] + 1)
                first.append(end)
                p = last
                while p >= 0 and word not in next_[p]:
                    next_[p][word] = state
                    p = link[p]
                if p >= 0:
                    q = next_[p][word]
                    if size[q] == size[p] + 1:
                        link[state] = q
                    else:
                        clone = len(next_)
                        next_.append(next_[q].copy())
                        link.append(link[q])
                        size.append(size[p] + 1)
                        first.append(first[q])
                        while p >= 0 and next_[p].get(word) == q:
                            next_[p][word] = clone
                            p = link[p]
                        link[q] = link[state] = clone
                last = state
                end += 1

    def first_ends(self, words: list[bytes], length: int) -> Iterator[int]:
        """For each word the first end of the ``length`` words that end with it, or -1 where they don't occur:
        the matching statistics, capped at ``length``."""
        next_, link, size, first = self.next, self.link, self.size, self.first
        state = matched = 0
        for word in words:
            while state and word not in next_[state]:
                state = link[state]
                matched = size[state]
            further = next_[state].get(word)
            if further is None:
                matched = 0
            else:
                state = further
                matched = min(matched + 1, length)
                while size[link[state]] >= length:
                    state = link[state]
            yield first[state] if matched >= length else -1


def _shards(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Pieces in runs whose passages have about ``REFERENCE_WORDS`` words together."""
    held, words, known = [], 0, set()
    for piece in pieces:
        key = piece[2:5]
        if key not in known:
            if held and words + piece[1] > REFERENCE_WORDS:
                yield held
                held, words, known = [], 0, set()
            known.add(key)
            words += piece[1] + LENGTH - 1
        held.append(piece)
    if held:
        yield held


def _united(pieces: list[tuple], passage) -> list[tuple]:
    """The passages of pieces, overlapping ones united, in the order of the documents: id, block, place, text."""
    out = []
    for t_id, t_block, t_place, size in sorted({(p[5], *p[2:5]) for p in pieces}):
        text = passage((t_block, t_place, size))
        if out and out[-1][:2] == (t_id, t_block):
            *_, place, so_far = out[-1]
            over = place + len(so_far) - t_place
            if over >= size:
                continue
            if over > 0:
                out[-1] = (t_id, t_block, place, so_far + text[over:])
                continue
        out.append((t_id, t_block, t_place, text))
    return out


def without_repeats(block: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a block without their repeated passages."""
    number, data, ids = block.column("block")[0].as_py(), block.column("data")[0].as_py(), _ids(block)
    columns = ("t_block", "t_place", "bytes", "passage", "pieces")
    rows = list(zip(*(found.column(c).to_pylist() for c in columns)))
    sent = {r[:3]: r[3] for r in rows if r[4] is None}
    packed = b"".join(r[4] for r in rows if r[4] is not None)
    pieces = sorted(map(tuple, np.frombuffer(packed, np.int64).reshape(-1, 6).tolist()))

    def passage(key: tuple[int, int, int]) -> bytes:
        return sent[key] if key[0] != number else data[key[1] : key[1] + key[2]]

    octets = np.frombuffer(data, np.uint8)
    edge = np.diff(((octets != 32) & (octets != 10)).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(np.flatnonzero(octets == 10), starts)
    marks = np.zeros(len(starts) + 1, np.int64)
    for part in _shards(pieces):
        references = _united(part, passage)
        texts = [text.split(b" ") for *_, text in references]
        automaton = SuffixAutomaton(texts)
        origin = [r[:2] for r, words in zip(references, texts) for _ in range(len(words) + 1)]
        place_of = []
        for (_, _, place, _), words in zip(references, texts):
            for word in words:
                place_of.append(place)
                place += len(word) + 1
            place_of.append(-1)
        for word, windows, *_ in part:
            last = word + windows + LENGTH - 1
            own = (int(ids[line[word]]), number)
            words = data[starts[word] : ends[last - 1]].split(b" ")
            for i, end in enumerate(automaton.first_ends(words, LENGTH), word - LENGTH + 1):
                if end >= 0 and (origin[end] < own or (origin[end] == own and place_of[end - LENGTH + 1] < starts[i])):
                    marks[i] += 1
                    marks[i + LENGTH] -= 1
    removed = np.cumsum(marks[:-1]) > 0
    head = np.searchsorted(line, np.arange(len(ids) + 1))
    kept, n_removed, span_starts, span_ends = [], [], [], []
    for text, a, b in zip(data.split(b"\n"), head, head[1:]):
        gone = removed[a:b]
        n_removed.append(int(gone.sum()))
        turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        span_starts.append(turn[::2])
        span_ends.append(turn[1::2])
        kept.append(b" ".join(w for w, g in zip(text.split(b" "), gone) if not g) if n_removed[-1] else text)
    return pa.table({
        "id": block.column("ids")[0].values, "n_words": pa.array(np.diff(head)), "n_removed": pa.array(n_removed, pa.int64()),
        "starts": pa.array(span_starts, pa.list_(pa.int64())), "ends": pa.array(span_ends, pa.list_(pa.int64())),
        "kept": pa.array([k.decode() for k in kept], pa.string()),
    })


def remove_passages(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed, starts, ends (the removed spans, by words) and kept of every row."""
    table = blocks(df, id_column, text)
    shards = (table.agg(F.sum("n_words").alias("words")).first().words or 0) // SHARD_WORDS + 1
    texts = table.select("block", "ids", "data").groupBy("block")
    repeated = (
        table.select("block", "data").mapInArrow(ask_anchors(shards), ANCHORS)
        .groupBy("shard").applyInArrow(answer_anchors, "block long, shard int, bits binary, n int")
    )
    firsts = (
        texts.cogroup(repeated.groupBy("block")).applyInArrow(ask_windows(shards), WINDOWS)
        .groupBy("shard").applyInArrow(answer_windows, FIRSTS)
    )
    pieces = written(texts.cogroup(firsts.groupBy("block")).applyInArrow(find_pieces, PIECES), "pieces")
    key = ["t_block", "t_place", "bytes"]
    asked = pieces.where("pieces IS NULL").select("block", *key)
    sources = table.select(F.col("block").alias("t_block"), "data").groupBy("t_block")
    cut = sources.cogroup(asked.select(*key).distinct().groupBy("t_block")).applyInArrow(cut_passages, PASSAGES)
    passages = asked.join(cut, key).select("block", *key, "passage")
    found = pieces.where("pieces IS NOT NULL").unionByName(passages, allowMissingColumns=True)
    return texts.cogroup(found.groupBy("block")).applyInArrow(without_repeats, RESULT)
