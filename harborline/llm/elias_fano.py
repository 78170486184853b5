"""Elias-Fano sequences and a bigram trie over them, in numpy, as memory-mapped files."""

from __future__ import annotations

import os
import tempfile

import numpy as np

U64 = np.uint64


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th set bit within each 64-bit word."""
    words, rank = words.copy(), rank.copy()
    place = np.zeros(len(words), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(words & U64((1 << step) - 1)).astype(np.int64)
        further = rank >= count
        rank -= np.where(further, count, 0)
        words = np.where(further, words >> U64(step), words)
        place += np.where(further, step, 0)
    return place


class EliasFano:
    """A non-decreasing sequence. The low bits of a value are stored as they are; the rest is the
    number of zeros before its one in a bit vector, found by select with a count for each word."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.n, self.bits, self.top = (int(x) for x in arrays["shape"])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, U64)
        if bits:
            part = values & U64((1 << bits) - 1)
            at = np.arange(n, dtype=U64) * U64(bits)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            np.add.at(low, word, part << shift)  # fields don't overlap, so adding is uniting
            over = (shift + U64(bits)) > U64(64)
            np.add.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        ones = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        size = ((top >> bits) + n) // 64 + 2
        high = np.zeros(size, U64)
        np.add.at(high, ones >> 6, U64(1) << (ones & 63).astype(U64))
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {"low": low, "high": high, "ones": counts, "shape": np.array([n, bits, top], np.int64)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i.astype(U64) * U64(self.bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        value = self.low[word] >> shift
        over = (shift + U64(self.bits)) > U64(64)
        value[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return value & U64((1 << self.bits) - 1)

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        return word * 64 + _select(~self.high[word], rank - self.zeros[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word])
        return ((place - i).astype(U64) << U64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first value of at least x, or the length."""
        x = np.asarray(x, U64)
        found = np.full(len(x), self.n, np.int64)
        inside = np.flatnonzero(x <= U64(self.top)) if self.n else np.zeros(0, np.int64)
        x = x[inside]
        high = (x >> U64(self.bits)).astype(np.int64)
        low = x & U64((1 << self.bits) - 1)
        first = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - high + 1, 0)
        last = self._zero(high) - high
        while True:
            open_ = np.flatnonzero(first < last)
            if not len(open_):
                break
            middle = (first[open_] + last[open_]) >> 1
            less = self._low(middle) < low[open_]
            first[open_] = np.where(less, middle + 1, first[open_])
            last[open_] = np.where(less, last[open_], middle)
        found[inside] = first
        return found


class BigramTrie:
    """Contexts, monotone pointers to the ranges of their successors, the successors, and one
    quantised probability for each. Successors rise within a context; each range is shifted by
    the last value of the one before, so the whole level is one rising sequence and a word is
    found by a successor search relative to its context."""

    LEVELS = ("contexts", "pointers", "successors")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for level in self.LEVELS:
            setattr(self, level, EliasFano({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(level)}))
        self.codes = arrays["codes"]

    @classmethod
    def mapped(cls, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> BigramTrie:
        """Builds the levels, writes them to a file and maps it. The file has no name any more
        once it is mapped, so nothing is left behind, however the task ends."""
        ends = np.cumsum(sizes)
        last = successors[ends - 1].astype(U64) + U64(1) if len(sizes) else np.zeros(0, U64)
        shift = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(U64) if len(sizes) else np.zeros(0, U64)
        arrays = {"codes": codes}
        for level, values in (
            ("contexts", contexts),
            ("pointers", np.concatenate([[0], ends])),
            ("successors", successors.astype(U64) + U64(1) + np.repeat(shift, sizes)),
        ):
            arrays |= {f"{level}.{k}": v for k, v in EliasFano.build(values).items()}
        handle, path = tempfile.mkstemp(prefix="trie-")
        places = {}
        try:
            with os.fdopen(handle, "wb") as file:
                for name, array in arrays.items():
                    file.write(b"\0" * (-file.tell() % 8))
                    places[name] = (file.tell(), array.dtype, len(array))
                    file.write(array.tobytes())
                file.write(b"\0" * 8)
            whole = np.memmap(path, np.uint8, mode="r")
        finally:
            os.unlink(path)
        return cls({
            name: whole[at : at + n * dtype.itemsize].view(dtype) for name, (at, dtype, n) in places.items()
        })

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The codes of the bigrams; 0 where a bigram is not stored."""
        found = self.find(contexts, words)
        return np.where(found >= 0, self.codes[np.maximum(found, 0)], np.uint16(0)) if len(self.codes) else np.zeros(len(words), np.uint16)

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The numbers of the bigrams in their level; -1 where a bigram is not stored."""
        out = np.full(len(words), -1, np.int64)
        if not self.contexts.n or not len(words):
            return out
        # Queries come grouped by context: a context is searched once.
        own, inverse = np.unique(np.asarray(contexts, U64), return_inverse=True)
        place = self.contexts.successor(own)
        known = place < self.contexts.n
        known[known] = self.contexts.access(place[known]) == own[known]
        place = np.where(known, place, 0)
        first = self.pointers.access(place).astype(np.int64)
        after = self.pointers.access(place + 1).astype(np.int64)
        shift = np.where(first > 0, self.successors.access(np.maximum(first - 1, 0)), U64(0))
        at = np.flatnonzero(known[inverse])
        mine = inverse[at]
        target = shift[mine] + np.asarray(words, U64)[at] + U64(1)
        found = self.successors.successor(target)
        inside = np.flatnonzero(found < after[mine])
        hit = inside[self.successors.access(found[inside]) == target[inside]]
        out[at[hit]] = found[hit]
        return out
