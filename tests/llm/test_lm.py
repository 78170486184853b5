"""Elias-Fano against sorted arrays, the model's scores against plain dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from harborline.llm import lm
from harborline.llm.elias_fano import BigramTrie, EliasFano
from harborline.llm.queries import QUERIES
from harborline.llm.tables import documents
from tests.llm.edge import ROWS, edge_rows, empty_rows, texts


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 2**50), (5, 3), (1000, 10), (1000, 10**6), (5000, 2**45)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    sequence = EliasFano(EliasFano.build(values))
    if n:
        assert (sequence.access(np.arange(n)) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 2 * top, 200).astype(np.uint64)])
    assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie():
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))})
    contexts = sorted({a for a, _ in pairs})
    sizes = np.array([sum(a == c for a, _ in pairs) for c in contexts])
    codes = np.arange(1, len(pairs) + 1, dtype=np.uint16)
    trie = BigramTrie.mapped(np.array(contexts), sizes, np.array([b for _, b in pairs]), codes)
    want = dict(zip(pairs, codes))
    asked = np.array([(a, b) for a in range(65) for b in range(65)])
    assert trie.lookup(asked[:, 0], asked[:, 1]).tolist() == [want.get((a, b), 0) for a, b in asked.tolist()]
    none = np.zeros(0, np.uint64)
    assert BigramTrie.mapped(none, none.astype(int), none, none.astype(np.uint16)).lookup(asked[:, 0], asked[:, 1]).tolist() == [0] * len(asked)


@pytest.mark.parametrize("values", [[], [0], [127, 128, 0, 2**14, 2**40, 1], list(range(0, 70000, 7))])
def test_packed_numbers(values):
    assert lm.unpacked_numbers(lm.packed_numbers(np.array(values, np.uint64)).tobytes()).tolist() == values


def brute(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None] for _, t in rows]
    train = [t for t, h in zip(tokens, held) if not h]
    single = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["start", *t], t))
    total, distinct = sum(single.values()), len(single)
    contexts = Counter(p[0] for t in train for p in zip(["start", *t], t))
    out = []
    for (i, _), h, t in zip(rows, held, tokens):
        base = [math.log10((single[w] + 1) / (total + distinct + 1)) for w in t]
        score = 0
        for v, w in zip(["start", *t], t):
            p = (single[w] + 1) / (total + distinct + 1)
            score += math.log10(lm.MIX * pairs[v, w] / contexts[v] + (1 - lm.MIX) * p if contexts[v] else p)
        out.append((i, h, len(t), sum(single[w] > 0 for w in t), total, sum(base), score))
    return out


def check(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert len(found) == len(want)
    for f, w in zip(found, want):
        assert f[:5] == w[:5]
        assert f[5] == pytest.approx(w[5], abs=1e-6)
        assert f[7] == pytest.approx(w[6], abs=f[2] * 0.5 / lm.STEPS + 1e-6)


@pytest.mark.parametrize("small", [False, True])
def test_query_by_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, many shards, hot contexts dealt out by word
        monkeypatch.setattr(lm, "BLOCK_BYTES", 30_000)
        monkeypatch.setattr(lm, "SHARD_WORDS", 5_000)
        monkeypatch.setattr(lm, "SHARD_TOKENS", 5_000)
    path = "/root/testdata/sf0.001"
    check(QUERIES["op2_lm_score"](spark, path).collect(), brute(texts(documents(spark, path))))


def test_held_out_texts_gain_over_the_base(spark):
    rows = [r for r in QUERIES["op2_lm_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edge_rows(spark):
    rows = [(i, t or "") for i, t, _ in ROWS]
    check(lm.score(edge_rows(spark)).collect(), brute(rows))
    assert lm.score(empty_rows(spark)).count() == 0
    from pyspark.sql import functions as F

    unlearned = lm.score(edge_rows(spark), F.lit(True)).collect()
    assert len(unlearned) == len(ROWS) and all(r.score == r.base_score == 0 and r.n_known == 0 for r in unlearned)


def brute_trigrams(rows):
    """The score of order three of every row, with the mixed score of order two below it."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [["start", *re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None] for _, t in rows]
    train = [t for t, h in zip(tokens, held) if not h]
    single = Counter(w for t in train for w in t[1:])
    pairs = Counter(p for t in train for p in zip(t, t[1:]))
    triples = Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    contexts = Counter(w for t in train for w in t[:-1])
    below = sum(single.values()) + len(single) + 1
    out = []
    for t in tokens:
        score = 0
        for i in range(1, len(t)):
            v, w = t[i - 1 : i + 1]
            p = (single[w] + 1) / below
            p = lm.MIX * pairs[v, w] / contexts[v] + (1 - lm.MIX) * p if contexts[v] else p
            seen = pairs[t[i - 2], v] if i > 1 else 0
            score += math.log10(lm.MIX_THREE * triples[t[i - 2], v, w] / seen + (1 - lm.MIX_THREE) * p if seen else p)
        out.append(score)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_order_three_by_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lm, "BLOCK_BYTES", 30_000)
        monkeypatch.setattr(lm, "SHARD_TOKENS", 5_000)
    rows = texts(documents(spark, "/root/testdata/sf0.001"))
    found = {r.doc_id: r for r in QUERIES["op2_lm_score"](spark, "/root/testdata/sf0.001").collect()}
    for (i, _), want in zip(rows, brute_trigrams(rows), strict=True):
        assert found[i].score == pytest.approx(want, abs=found[i].n_tokens * 1.0 / lm.STEPS + 1e-6)


def test_words_before_the_last_count(spark):
    """Two texts that differ only two words before a word have the same bigrams, but not the same trigrams."""
    rows = [(i, "a b c" if i % 2 else "x b d") for i in range(40)] + [(100, "a b d"), (101, "x b d")]
    found = {r.id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert found[101].score > found[100].score + 0.2
