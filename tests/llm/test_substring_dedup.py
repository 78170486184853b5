"""Removal of repeated passages against brute force and SQL."""

import random

import pyarrow as pa
import pytest

from harborline.llm import substring_dedup
from tests.llm.edge import edge_rows, empty_rows, texts

LENGTH = 20


def plain(rows):
    """Words and removed marks of each row; rows in the order in which they count as earlier or later."""
    seen, out = set(), []
    for _, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - LENGTH + 1):
            window = tuple(words[i : i + LENGTH])
            if window in seen:
                gone[i : i + LENGTH] = [True] * LENGTH
            seen.add(window)
        out.append((words, gone))
    return out


def kept(words, gone):
    return b" ".join(w for w, g in zip(words, gone) if not g).decode()


def passages(draw, n, alphabet="ab"):
    """Texts of few words, of shared passages and of words of their own."""
    shared = [" ".join(draw.choices([f"w{k}" for k in range(50)], k=draw.randint(25, 70))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 6)):
            kind = draw.randint(0, 3)
            if kind == 0:
                parts.append(" ".join(draw.choices(alphabet, k=draw.randint(1, 60))))
            elif kind == 1:
                parts.append(draw.choice(shared)[draw.randint(0, 40) :])
            elif kind == 2:
                parts.append(" ".join(f"own{i}x{k}" for k in range(draw.randint(1, 50))))
            else:
                parts.append(shared[0])  # the hot passage
        out.append("\n \t".join(parts))
    return out


def check(df, rows):
    found = {r.id: r for r in df.collect()}
    assert len(found) == len(rows)
    for (id_, _), (words, gone) in zip(rows, plain(rows)):
        r = found[id_]
        assert (r.n_words, r.n_removed, r.kept) == (len(words), sum(gone), kept(words, gone)), id_
        marks = [any(a <= i < b for a, b in zip(r.starts, r.ends)) for i in range(len(words))]
        assert marks == gone and all(b < a for b, a in zip(r.ends, r.starts[1:]))


@pytest.mark.parametrize("partitions", [1, 9])
def test_words_equal_brute_force(spark, partitions):
    draw = random.Random(partitions)
    rows = list(enumerate(passages(draw, 90)))
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string").repartition(partitions)
    check(substring_dedup.remove_passages(df), rows)


@pytest.mark.parametrize("reference,windows", [(1, 3), (60, 25), (20_000, 10_000)])
def test_shards_and_pieces_do_not_change_the_result(monkeypatch, reference, windows):
    monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", reference)
    monkeypatch.setattr(substring_dedup, "PIECE_WINDOWS", windows)
    if reference == 60:
        monkeypatch.setattr(substring_dedup, "STEP", 64)
        monkeypatch.setattr(substring_dedup, "HASHED_BYTES", 50)
    rows = list(enumerate(passages(random.Random(4), 40)))
    data = b"\n".join(b" ".join(t.encode().split()) for _, t in rows)
    block = pa.table({"block": [7], "ids": [[i for i, _ in rows]], "data": pa.array([data], pa.binary())})
    pieces = substring_dedup.find_pieces(block, substring_dedup._firsts([]))
    assert len(pieces) == 1  # one block asks no other
    pieces = pieces.append_column("passage", pa.nulls(len(pieces), pa.binary()))
    result = substring_dedup.without_repeats(block, pieces).to_pylist()
    for r, (words, gone) in zip(result, plain(rows), strict=True):
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(words), sum(gone), kept(words, gone))


def test_automaton_knows_first_ends():
    draw = random.Random(2)
    for _ in range(20):
        reference = [[b"x", b"y"][draw.random() < 0.3] for _ in range(60)]
        words = [[b"x", b"y", b"z"][min(2, int(draw.expovariate(1.5)))] for _ in range(80)]
        got = list(substring_dedup.SuffixAutomaton([reference[:25], reference[25:]]).first_ends(words, 4))
        stream = [*reference[:25], None, *reference[25:]]
        for i, end in enumerate(got):
            places = [j for j in range(3, len(stream)) if i >= 3 and stream[j - 3 : j + 1] == words[i - 3 : i + 1]]
            assert end == (places[0] if places else -1)


def test_edge_rows(spark):
    rows = sorted(texts(edge_rows(spark)), key=lambda r: (r[0] is not None, r[0] or 0))
    found = substring_dedup.remove_passages(edge_rows(spark)).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    expected = [(i, len(words), sum(gone), kept(words, gone)) for (i, _), (words, gone) in zip(rows, plain(rows))]
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept) for r in found], key=key) == sorted(expected, key=key)


def test_rows_with_one_id_lose_all_but_one_copy(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(5, text)] * 6 + [(None, text)], "doc_id long, text string").repartition(4)
    assert sorted((r.id is None, r.n_removed) for r in substring_dedup.remove_passages(df).collect()) == [(False, 30)] * 6 + [(True, 0)]


def test_nothing(spark):
    assert substring_dedup.remove_passages(empty_rows(spark)).count() == 0
