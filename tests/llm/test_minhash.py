"""Signatures against weighted Jaccard similarity; classes against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from harborline.llm import minhash
from harborline.llm.queries import QUERIES
from harborline.llm.tables import documents
from tests.llm.edge import ROWS, edge_rows, empty_rows, texts


def shingles(text):
    words = re.findall(r"\w+", text.lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute_links(sets):
    """All pairs of different sets with a similarity of 0.8 or more, by shared shingles."""
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    found = set()
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                found.add((j, i))
    return found


def brute_classes(rows):
    """The smallest id of each row's class."""
    sets = list({shingles(t) for _, t in rows})
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_links(sets):
        parent[root(a)] = root(b)
    index = {s: i for i, s in enumerate(sets)}
    members = defaultdict(list)
    for i, t in rows:
        members[root(index[shingles(t)])].append(i)
    return Counter((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in members.values() for i in ids)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_by_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = QUERIES["op5_minhash"](spark, path).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in rows) == brute_classes(texts(documents(spark, path)))
    assert sum(r.kept for r in rows) == len({r.class_id for r in rows})


def test_edge_rows(spark):
    rows = minhash.classes(edge_rows(spark)).collect()
    assert Counter((r.id, r.class_id, r.class_size) for r in rows) == brute_classes([(i, t or "") for i, t, _ in ROWS])
    assert sum(r.kept for r in rows) == len({t for t in brute_classes([(i, t or "") for i, t, _ in ROWS])} and {shingles(t or "") for _, t, _ in ROWS})
    assert minhash.classes(empty_rows(spark)).count() == 0


def test_chains_and_a_large_bucket(spark):
    """A chain of edits, of which only neighbours are alike, and many variants of one text."""
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join([*base[2 * i :], *(f"n{j}" for j in range(2 * i))]) for i in range(30)]
    other = [f"v{i}" for i in range(200)]
    variants = [" ".join([*other[:k], f"x{k}", *other[k + 1 :]]) for k in range(0, 200, 2)]
    rows = list(enumerate(chain + variants))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.classes(df).collect()
    assert Counter((r.id, r.class_id, r.class_size) for r in found) == brute_classes(rows)
    assert len({r.class_id for r in found}) == 2


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    maker = minhash.Signatures(4096)
    for n, scale in ((30, 1.0), (400, 1.0), (60, 5.0)):
        elements = rng.integers(1, 2**63, n, dtype=np.uint64)
        a, b = rng.random(n) * scale + 0.05, rng.random(n) * scale + 0.05
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = maker.of([(elements, a), (elements, b)])
        assert abs((s[0] == s[1]).mean() - want) < 0.04, (n, scale)


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(4)
    maker = minhash.Signatures(280)
    sets = [(rng.integers(1, 2**63, n, dtype=np.uint64), np.ones(n)) for n in (1, 2, 7, 100, 5000, 40000)]
    together = maker.of(sets)
    for i, s in enumerate(sets):
        assert (maker.of([s])[0] == together[i]).all()
    assert (together != 0).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30], "low long, high long")
    labels = dict(map(tuple, minhash.components(edges).collect()))
    assert set(labels.values()) == {0, 31} and len(labels) == 61


def test_sketches_bound_similarity():
    """No pair of the threshold is ruled out, at any size; most unlike pairs of small sets are."""
    rng = np.random.default_rng(5)
    spared = 0
    for n in (1, 5, 70, 300, 9000):
        for share in (0.5, 0.7, 0.8, 0.9, 1.0):
            common = rng.integers(0, 2**32, n, dtype=np.uint32)
            sets = [np.unique(np.concatenate([common[: int(n * share)], rng.integers(0, 2**32, n - int(n * share), dtype=np.uint32)])) for _ in range(20)]
            sets += [common, np.unique(common)[: n // 2 + 1]]
            sketches = [minhash.sketch(np.unique(s)) for s in sets]
            for a, own in zip(sets, sketches):
                possible = minhash.may_link(own, sketches, 0.8)
                for b, may in zip(sets, possible):
                    shared = len(np.intersect1d(a, b))
                    alike = shared >= 0.8 * (len(np.unique(a)) + len(np.unique(b)) - shared)
                    assert may or not alike
                    spared += not may
    assert spared > 3000
    crowded = np.full(300, 16, np.uint32)
    assert minhash.sketch(crowded) == b"" and minhash.may_link(b"", [b"", minhash.sketch(common)], 0.8).all()


def test_copies_edited_to_every_degree(spark):
    """Variants from close to far of one text share buckets for several rounds."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 14)):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    found = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.id, r.class_id, r.class_size) for r in found) == brute_classes(rows)


def signed_texts(spark, sets, bands):
    """Texts with chosen elements and band keys; a missing key is one of its own."""
    width = max(map(len, bands.values()))
    rows = []
    for t, elements in sets.items():
        keys = [*bands[t], *[None] * (width - len(bands[t]))]
        own = sorted(np.array(sorted(elements), np.uint32).view(np.int32).tolist())
        rows.append((t, [k if k is not None else -(100 * t + i + 1) for i, k in enumerate(keys)], own, bytearray(minhash.sketch(np.array(sorted(elements), np.uint32)))))
    return spark.createDataFrame(rows, "text long, bands array<long>, elements array<int>, sketch binary")


@pytest.mark.parametrize("block", [1 << 17, 150])
def test_link_between_texts_that_are_no_pivots(spark, monkeypatch, block):
    """p~x, x~y and y~q, but q~y meet in a bucket of their own, so p and q are the pivots of the common one."""
    monkeypatch.setattr(minhash, "BLOCK_ELEMENTS", block)
    p, x, q, y = 1, 2, 3, 4
    sets = {t: set(range(10 * at, 10 * at + 100)) for t, at in ((p, 0), (x, 1), (y, 2), (q, 3))}
    table = signed_texts(spark, sets, {p: [7, None], x: [7, None], q: [7, 8], y: [7, 8]})
    assert {r.label for r in minhash.components_of_texts(table).collect()} == {p}


@pytest.mark.parametrize("block", [1 << 17, 2000])
def test_two_dense_groups_joined_by_a_single_link(spark, monkeypatch, block):
    """All texts share a bucket, each group a second one; one pair of the last texts of the groups is alike."""
    monkeypatch.setattr(minhash, "BLOCK_ELEMENTS", block)
    rng = np.random.default_rng(7)
    for linked in (True, False):
        sets, bands = {}, {}
        for group in range(2):
            for i in range(30):
                # The last texts of the groups are moved towards each other.
                middle = i == 29
                at = (10 if group == 0 else 20 if linked else 40) if middle else (0 if group == 0 else 30 if linked else 50)
                t = 2 * i + group
                sets[t] = set(range(at, at + 100)) if middle else set(range(at, at + 100)) - {at + int(rng.integers(40, 60))}
                bands[t] = [7, 8 + group]
        found = {r.text: r.label for r in minhash.components_of_texts(signed_texts(spark, sets, bands)).collect()}
        names = list(sets)
        parent = dict(zip(names, names))

        def root(t):
            while parent[t] != t:
                t = parent[t]
            return t

        for a, b in brute_links([sets[t] for t in names]):
            parent[max(root(names[a]), root(names[b]))] = min(root(names[a]), root(names[b]))
        assert found == {t: root(t) for t in names}
        assert len(set(found.values())) == (1 if linked else 2)
