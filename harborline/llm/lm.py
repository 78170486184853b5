"""Language-model scores of whole texts by an Elias-Fano trie of bigrams and trigrams in shards.

The model. p(w) = (c(w) + 1) / (N + V + 1) over training tokens, unknown words included, and
p(w | v) = L c(v w) / c(v) + (1 - L) p(w), or p(w) where the context v does not occur in training.
p(w | u v) = M c(u v w) / c(u v) + (1 - M) p(w | v), or p(w | v) where u v does not occur in training and
for the first word. All sum to at most one. A text is its words and then one end; the first word's context
is a start. ``MIX`` is L, ``MIX_THREE`` is M. ``score`` is of order three, ``bigram_score`` of order two.

The work, all of which grows with the corpus and is dealt out evenly:

1. Blocks. Each task packs its texts into blocks of about ``BLOCK_BYTES`` and numbers the
   distinct words of a block in the order of their hashes. The blocks are written as a table bucketed by
   block, so no later step moves texts.
2. Words. Every block sends its distinct words with their training counts to shards by ranges of the
   hash, and a shard answers every block with the numbers and corpus counts of its words.
3. Questions. Every block sends its distinct bigrams and trigrams with their training counts, as paths of
   one trie, to the shard of their first word: rising numbers as differences in variable-length bytes. The
   paths of a first word with more than a shard's share of the corpus are dealt out by the second word too, and
   the trigrams of two such words by the third.
4. Trie. A shard adds the counts up, builds the two levels over the training texts (contexts, monotone
   pointers, successors, quantised log probabilities), maps them into memory, and answers every block with the
   codes of its bigrams and trigrams by successor searches relative to their contexts.
5. Scores. Each block scores its texts from the answers.

A block sends a path once, however common it is, so neither a hot word nor a hot
pair nor a large group of copies makes a shard large. Texts never leave their block's row.

Tokens: A to Z lower-cased; words are runs of characters other than blank and U+0009 to U+000D.

Defined results: a null or empty text is the end alone. Without training texts every probability is
1 / (N + V + 1) = 1. A null id counts as the empty text where the fold is chosen. Repeated rows score alike.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.elias_fano import BigramTrie
from harborline.llm.tables import bucketed, slices, text_of
from harborline.llm.words import mixed

BLOCK_BYTES = 12 * 1024 * 1024
SHARD_WORDS = 1_500_000
#: Tokens in all for which there is one shard of paths.
SHARD_TOKENS = 1_500_000
#: L and M: the weights of the bigram's and of the trigram's share, near the best of a grid over one fold of
#: sf0.1 scored from the others, one row for each text.
MIX = 0.35
MIX_THREE = 0.4
#: Steps of a quantised log10 in one unit.
STEPS = 2048

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
END = b" "
BLOCK = "block long, ids array<long>, held array<boolean>, lengths array<int>, n_words int, tokens binary, words binary, counts binary"


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 7 == 2


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


class _Block:
    def __init__(self):
        self.ids, self.held, self.tokens, self.bytes = [], [], [], 0
        self.numbers = _Numbers()

    def add(self, id_, held: bool, text: str) -> None:
        data = text.encode().lower()
        words = data.split()  # bytes: blank and U+0009 to U+000D only
        words.append(END)
        self.ids.append(id_)
        self.held.append(held)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.bytes += len(data) + 1

    def row(self, number: int) -> pa.RecordBatch:
        words = list(self.numbers)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        tokens = place[np.concatenate(self.tokens)]
        lengths = np.array([len(t) for t in self.tokens], np.int32)
        train = np.repeat(~np.array(self.held, bool), lengths)
        counts = np.bincount(tokens[train], minlength=len(words)).astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([self.held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([len(words)], pa.int32()), pa.array([tokens.tobytes()], pa.binary()),
                pa.array([b"\n".join(words[i] for i in order)], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
            ],
            names=["block", "ids", "held", "lengths", "n_words", "tokens", "words", "counts"],
        )


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    block = _Block()
    for batch in batches:
        for part in slices(batch, "text"):
            for id_, held, text in zip(*(part.column(c).to_pylist() for c in ("id", "held", "text"))):
                block.add(id_, held, text)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(number)
                    number, block = number + 1, _Block()
    if block.ids:
        yield block.row(number)


def blocks(df: DataFrame, held: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    rows = df.select(F.col(id_column).cast("long").alias("id"), held.alias("held"), text_of(text).alias("text"))
    return bucketed(rows.mapInArrow(packed, BLOCK), "blocks", "block")


def _range_shards(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _binary(arrays) -> pa.Array:
    return pa.array([a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def ask_words(shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, joined, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts"))):
                words, counts = joined.split(b"\n"), np.frombuffer(counts, np.uint32)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                cuts = np.searchsorted(_range_shards(hashes, shards), np.arange(shards + 1))
                own = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _, _ in own], pa.int32()), pa.array([block] * len(own), pa.int64()),
                        _binary(b"\n".join(words[a:b]) for _, a, b in own), _binary(counts[a:b] for _, a, b in own),
                    ],
                    names=["shard", "block", "words", "counts"],
                )

    return ask


def answer_words(group: pa.Table) -> pa.Table:
    """The numbers, within the shard, and the corpus counts of each block's words."""
    numbers, counts, asked = _Numbers(), np.zeros(0, np.int64), []
    for joined, own in zip(group.column("words").to_pylist(), group.column("counts").to_pylist()):
        ids = np.fromiter(map(numbers.__getitem__, joined.split(b"\n")), np.int64)
        if len(numbers) > len(counts):
            counts = np.concatenate([counts, np.zeros(len(numbers), np.int64)])
        counts[ids] += np.frombuffer(own, np.uint32)  # a block names a word once
        asked.append(ids)
    total, distinct = int(counts.sum()), int((counts > 0).sum())
    n = len(asked)
    return pa.table({
        "block": group.column("block"), "shard": group.column("shard"),
        "ids": _binary(packed_numbers(ids) for ids in asked), "counts": _binary(packed_numbers(counts[ids]) for ids in asked),
        "total": pa.array([total] + [0] * (n - 1), pa.int64()), "distinct": pa.array([distinct] + [0] * (n - 1), pa.int64()),
    })


class _Known:
    """A block with the numbers and counts of its words. Words are renumbered in the order of their corpus
    numbers, from 1; 0 is the start, in both numberings."""

    def __init__(self, block: pa.Table, answers: pa.Table, shards: int, start_count: int):
        column = lambda c: block.column(c)[0].as_py()
        self.block, self.ids, self.held = column("block"), column("ids"), np.array(column("held"), bool)
        self.lengths = np.array(column("lengths"), np.int64)
        by_shard = sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "ids", "counts"))), key=lambda x: x[0])
        numbers = np.concatenate([unpacked_numbers(x[1]) * U64(shards) + U64(x[0]) for x in by_shard])
        counts = np.concatenate([unpacked_numbers(x[2]) for x in by_shard]).astype(np.int64)
        order = np.argsort(numbers)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        self.tokens = place[np.frombuffer(column("tokens"), np.uint32)]
        self.numbers = np.concatenate([np.zeros(1, U64), numbers[order] + U64(1)])
        self.counts = np.concatenate([[start_count], counts[order]])
        self.train = np.repeat(~self.held, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def paths(self):
        """The distinct bigrams (first << 32 | second) with the bigram of each token, the tokens that have two
        words before them, and the distinct trigrams (bigram << 32 | third) with the trigram of each of these."""
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 0
        pairs, of_pair = np.unique(before << 32 | self.tokens, return_inverse=True)
        inside = np.ones(len(self.tokens), bool)
        inside[self.starts] = False
        at = np.flatnonzero(inside)
        triples, of_triple = np.unique(of_pair[at - 1] << 32 | self.tokens[at], return_inverse=True)
        return pairs, of_pair, at, triples, of_triple


def packed_numbers(values: np.ndarray) -> np.ndarray:
    """Numbers in seven bits a byte, the lowest first; the last byte of a number is below 128."""
    v = np.asarray(values).astype(U64)
    sizes, rest = np.ones(len(v), np.int64), v >> U64(7)
    while rest.any():
        sizes += rest > 0
        rest >>= U64(7)
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[first[has] + k] = ((v[has] >> U64(7 * k)) & U64(127)).astype(np.uint8) | ((sizes[has] > k + 1).astype(np.uint8) << 7)
    return out


def unpacked_numbers(data: bytes) -> np.ndarray:
    octets = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(octets < 128)
    first = np.concatenate([np.zeros(min(len(last), 1), np.int64), last[:-1] + 1])
    sizes = last - first + 1
    out = (octets[first] & 127).astype(U64)
    for k in range(1, int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[has] |= (octets[first[has] + k] & 127).astype(U64) << U64(7 * k)
    return out


def _steps(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of values that rise within groups; ``new`` are the first places of the groups."""
    out = values.copy()
    out[1:] -= values[:-1]
    out[new] = values[new]
    return out


def _summed(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The inverse of ``_steps``."""
    sums = np.cumsum(steps)
    base = np.zeros(len(new), U64)
    base[1:] = sums[new[1:] - 1]
    return sums - np.repeat(base, np.diff(np.append(new, len(steps))))


class _Dealt:
    """The paths of a block, dealt out to shards. An entry is a bigram in a shard, with its trigrams there."""

    def __init__(self, known: _Known, pairs: np.ndarray, triples: np.ndarray, shards: int, share: int):
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        hot = known.counts > share
        key = mixed(known.numbers[first] + GOLDEN)
        spread = hot[first]
        key[spread] = mixed(key[spread] + known.numbers[second[spread]])
        self.split = spread & hot[second]
        home = _range_shards(key, shards)
        bigram, third = triples >> 32, triples & 0xFFFFFFFF
        shard = home[bigram]
        apart = np.flatnonzero(self.split[bigram])
        shard[apart] = _range_shards(mixed(key[bigram[apart]] + known.numbers[third[apart]]), shards)
        # every bigram at home, and split ones wherever their trigrams are
        more = np.unique(shard[apart] << 32 | bigram[apart])
        more = more[more >> 32 != home[more & 0xFFFFFFFF]]
        self.pair = np.concatenate([np.arange(len(pairs)), more & 0xFFFFFFFF])
        self.shard = np.concatenate([home, more >> 32])
        self.at_home = np.arange(len(self.pair)) < len(pairs)
        order = np.argsort(self.pair, kind="stable")
        small = np.uint16 if shards <= 65536 else np.int64
        order = order[np.argsort(self.shard[order].astype(small), kind="stable")]
        self.pair, self.shard, self.at_home = self.pair[order], self.shard[order], self.at_home[order]
        #: the order in which bigrams at home and trigrams are sent, and answered
        self.homes = self.pair[self.at_home]
        self.triples = np.argsort(shard.astype(small), kind="stable")
        self.triple_shard = shard[self.triples]


ASKED = "shard int, block long, contexts binary, totals binary, sizes binary, seconds binary, counts binary, thirds binary, third_counts binary, n_thirds binary"
ANSWERED = "block long, shard int, codes binary, third_codes binary, split_counts binary"
STREAMS = ("contexts", "totals", "sizes", "seconds", "counts", "n_thirds", "thirds", "third_counts")


def ask_paths(word_shards: int, shards: int, share: int, start_count: int):
    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        known = _Known(block, answers, word_shards, start_count)
        pairs, of_pair, at, triples, of_triple = known.paths()
        counts = np.bincount(of_pair[known.train], minlength=len(pairs))
        third_counts = np.bincount(of_triple[known.train[at]], minlength=len(triples))
        dealt = _Dealt(known, pairs, triples, shards, share)
        first, second = known.numbers[pairs[dealt.pair] >> 32], known.numbers[pairs[dealt.pair] & 0xFFFFFFFF]
        word_counts = known.counts[pairs[dealt.pair] >> 32]
        bigram, third = triples[dealt.triples] >> 32, known.numbers[triples[dealt.triples] & 0xFFFFFFFF]
        own = 2 * np.where(dealt.at_home, counts[dealt.pair] + 1, 0) + dealt.split[dealt.pair]
        cuts = np.searchsorted(dealt.shard, np.arange(shards + 1))
        third_cuts = np.searchsorted(dealt.triple_shard, np.arange(shards + 1))
        rows = []
        for s in np.flatnonzero(np.diff(cuts)):
            e, t = slice(cuts[s], cuts[s + 1]), slice(third_cuts[s], third_cuts[s + 1])
            u, pair, of = first[e], dealt.pair[e], bigram[t]
            new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            begin, end = np.searchsorted(of, pair), np.searchsorted(of, pair, side="right")
            total = word_counts[e][new]
            rows.append((
                int(s), _steps(u[new], np.zeros(1, np.int64)), np.where(total > share, total, 0), np.diff(np.append(new, len(u))),
                _steps(second[e], new), own[e], end - begin, _steps(third[t], np.unique(begin[begin < end])), third_counts[dealt.triples[t]],
            ))
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([known.block] * len(rows), pa.int64()),
            **{name: _binary(packed_numbers(r[i + 1]) for r in rows) for i, name in enumerate(STREAMS)},
        }).select([f.split()[0] for f in ASKED.split(", ")])

    return ask


def quantised(log10: np.ndarray) -> np.ndarray:
    """Codes of log10 probabilities from 0 on downwards; 0 stands for none."""
    return np.clip(np.rint(-log10 * STEPS) + 1, 1, 65535).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) / STEPS), 0.0)


class _Asked:
    """What a block asked of a shard."""

    def __init__(self, streams: tuple[bytes, ...]):
        contexts, totals, sizes, seconds, own, n_thirds, thirds, third_counts = map(unpacked_numbers, streams)
        sizes, n_thirds = sizes.astype(np.int64), n_thirds.astype(np.int64)
        self.first = np.repeat(np.cumsum(contexts), sizes)
        self.total = np.repeat(totals.astype(np.int64), sizes)
        self.second = _summed(seconds, np.cumsum(sizes) - sizes)
        self.split = (own & U64(1)).astype(bool)
        own = (own >> U64(1)).astype(np.int64)
        self.at_home, self.counts = own > 0, np.maximum(own - 1, 0)
        some = np.flatnonzero(n_thirds)
        self.entry = np.repeat(np.arange(len(n_thirds)), n_thirds)
        self.third = _summed(thirds, (np.cumsum(n_thirds) - n_thirds)[some]) if len(thirds) else thirds
        self.third_counts = third_counts.astype(np.int64)


def _places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, by column, and the place of each pair among them."""
    if max(a.max(initial=0), b.max(initial=0)) < 2**32:
        pairs, place = np.unique(a.astype(U64) << U64(32) | b.astype(U64), return_inverse=True)
        return pairs >> U64(32), pairs & U64(0xFFFFFFFF), place
    order = np.lexsort((b, a))
    first, second = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return first[new].astype(U64), second[new].astype(U64), place


def _level(contexts: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> BigramTrie:
    head = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.zeros(0, np.int64)
    return BigramTrie.mapped(contexts[head], np.diff(np.append(head, len(contexts))), successors, codes)


def answer_paths(tokens: int):
    """``tokens``: all training tokens, the measure of the trigrams of split bigrams."""
    def answer(group: pa.Table) -> pa.Table:
        asked = [_Asked(streams) for streams in zip(*(group.column(c).to_pylist() for c in STREAMS))]
        whole = lambda name: np.concatenate([getattr(a, name) for a in asked])
        first, second, place = _places(whole("first"), whole("second"))
        counts = np.bincount(place, whole("counts"), len(first)).astype(np.int64)
        total, split = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        total[place], split[place] = whole("total"), whole("split")
        ends = np.append(np.flatnonzero(first[1:] != first[:-1]) + 1, len(first))
        sums = np.diff(np.concatenate([[0], np.cumsum(counts)[ends - 1]]))
        total = np.where(total > 0, total, np.repeat(sums, np.diff(np.concatenate([[0], ends]))))
        offset = np.cumsum([0, *(len(a.first) for a in asked)])
        bigram, third, third_place = _places(place[np.concatenate([a.entry + o for a, o in zip(asked, offset)])], whole("third"))
        bigram = bigram.astype(np.int64)
        third_counts = np.bincount(third_place, whole("third_counts"), len(bigram)).astype(np.int64)
        trained = third_counts > 0
        kept = counts > 0
        kept[bigram[trained]] = True
        number = np.cumsum(kept) - 1
        log = np.log10(MIX * np.maximum(counts, 1) / np.maximum(total, 1))
        codes = np.where(counts > 0, quantised(log), np.uint16(0)).astype(np.uint16)
        seconds = _level(first[kept], second[kept], codes[kept])
        under = bigram[trained]
        measure = np.maximum(np.where(split[under], tokens, counts[under]), 1)
        thirds = _level(number[under].astype(U64), third[trained], quantised(np.log10(MIX_THREE * third_counts[trained] / measure)))
        # Each distinct path is searched once, however many blocks ask for it.
        found = seconds.find(first, second)
        third_codes = np.zeros(len(bigram), np.uint16)
        inside = np.flatnonzero(found[bigram] >= 0)
        third_codes[inside] = thirds.lookup(found[bigram[inside]].astype(U64), third[inside])
        codes, split_counts = _taken(seconds.codes, found), _taken(counts[kept], found)
        answers, third_offset = [], 0
        for a, o in zip(asked, offset):
            own, after = place[o : o + len(a.first)], third_offset + len(a.entry)
            answers.append((codes[own[a.at_home]], third_codes[third_place[third_offset:after]], packed_numbers(split_counts[own[a.at_home & a.split]])))
            third_offset = after
        return pa.table({
            "block": group.column("block"), "shard": group.column("shard"),
            **{name: _binary(x[i] for x in answers) for i, name in enumerate(("codes", "third_codes", "split_counts"))},
        })

    return answer


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at the places; 0 for places below 0."""
    return np.append(values, values.dtype.type(0))[at]


SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bigram_score double"


def score_block(word_shards: int, shards: int, share: int, start_count: int, total: int, distinct: int):
    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        of_words = answers.column("counts").is_valid()
        known = _Known(block, answers.filter(of_words), word_shards, start_count)
        pairs, of_pair, at, triples, of_triple = known.paths()
        dealt = _Dealt(known, pairs, triples, shards, share)
        mine = answers.filter(answers.column("codes").is_valid())
        by_shard = sorted(zip(*(mine.column(c).to_pylist() for c in ("shard", "codes", "third_codes", "split_counts"))), key=lambda x: x[0])
        codes, third_codes = np.zeros(len(pairs), np.uint16), np.zeros(len(triples), np.uint16)
        codes[dealt.homes] = np.concatenate([np.frombuffer(x[1], np.uint16) for x in by_shard])
        third_codes[dealt.triples] = np.concatenate([np.frombuffer(x[2], np.uint16) for x in by_shard])
        of_split = np.ones(len(pairs))
        of_split[dealt.homes[dealt.split[dealt.homes]]] = np.concatenate([unpacked_numbers(x[3]) for x in by_shard])
        single = (known.counts + 1) / (total + distinct + 1)
        own = known.tokens
        mixed_in = np.where(known.counts[pairs >> 32] > 0, 1 - MIX, 1.0) * single[pairs & 0xFFFFFFFF]
        second = (mixed_in + probability(codes))[of_pair]
        log_second = np.log10(second)
        context = of_pair[at - 1]
        share_of_three = probability(third_codes)[of_triple]
        apart = dealt.split[context]
        share_of_three[apart] *= total / np.maximum(of_split[context[apart]], 1)
        third = second.copy()
        third[at] = np.where(codes[context] > 0, share_of_three + (1 - MIX_THREE) * second[at], second[at])
        sums = lambda x: pa.array(np.add.reduceat(x, known.starts))
        return pa.table({
            "id": pa.array(known.ids, pa.int64()), "held_out": pa.array(known.held), "n_tokens": pa.array(known.lengths),
            "n_known": sums((known.counts[own] > 0).astype(np.int64)), "train_tokens": pa.array([total] * len(known.ids), pa.int64()),
            "base_score": sums(np.log10(single)[own]), "score": sums(np.log10(third)), "bigram_score": sums(log_second),
        })

    return scored


def score(df: DataFrame, held: Column | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and bigram_score of every row.

    Texts for which ``held`` is true are scored but not learned from."""
    table = blocks(df, held_out(id_column) if held is None else held, id_column, text)
    sums = table.select(
        F.sum("n_words").alias("words"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"),
        F.sum(F.size(F.filter("held", lambda h: ~h))).alias("trained"),
    ).first()
    if not sums.tokens:
        return df.sparkSession.createDataFrame([], SCORES)
    word_shards = sums.words // SHARD_WORDS + 1
    numbers = bucketed(
        table.select("block", "words", "counts").mapInArrow(ask_words(word_shards), "shard int, block long, words binary, counts binary")
        .groupBy("shard").applyInArrow(answer_words, "block long, shard int, ids binary, counts binary, total long, distinct long"),
        "words", "block",
    )
    totals = numbers.agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    shards = sums.tokens // SHARD_TOKENS + 1
    settings = (word_shards, shards, sums.tokens // (4 * shards), sums.trained)
    texts = table.select("block", "ids", "held", "lengths", "tokens").groupBy("block")
    known = numbers.select("block", "shard", "ids", "counts")
    answers = (
        texts.cogroup(known.groupBy("block")).applyInArrow(ask_paths(*settings), ASKED)
        .groupBy("shard").applyInArrow(answer_paths(totals.total), ANSWERED)
    )
    both = known.unionByName(answers, allowMissingColumns=True)
    return texts.cogroup(both.groupBy("block")).applyInArrow(score_block(*settings, totals.total, totals.distinct), SCORES)
