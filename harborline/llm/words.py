"""Hashed words, shared by the operators that work on words inside Python tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words whose hashes one Python worker remembers; then it starts anew.
CACHED_WORDS = 200_000

words_of = re.compile(r"\w+").findall


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: lower-cased runs of letters, digits and underscores."""
    words = words_of(text.lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, length: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``length`` words. A shorter, not empty text is one
    run of all its words; an empty text has none."""
    n = len(words)
    if n == 0:
        return words
    runs = max(n - length + 1, 1)
    value = np.full(runs, min(n, length), np.uint64)
    for i in range(min(n, length)):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + words[i : i + runs])
    return np.unique(value)
