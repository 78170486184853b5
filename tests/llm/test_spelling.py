"""Spelling variants against brute force and SQL."""

import random
import zlib
from collections import Counter

import pytest

from harborline.llm import spelling
from harborline.llm.tables import documents
from tests.llm.edge import edge_rows, empty_rows, texts

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    letters = set(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
    counts = Counter()
    for id_, text in rows:
        runs, run = [], ""
        for c in text + " ":
            if c in letters:
                run += c.lower() if c < "\x80" else c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, n in words.items():
        near = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form[w], None, n, len(near), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def found(df):
    rows = df.collect()
    result = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(result) == len(rows)
    return result


def test_words_of_whole_texts(spark):
    docs = documents(spark, SF)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == plain_words(texts(docs))


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pieces_do_not_change_the_words(monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    text = "Überraschung, straße×straße ÀÉÎÕÜ kelvin K " + "a" * 50 + " x " * 9 + "ende"
    total = Counter()
    for word, n in spelling.document_words(3, text * 3):
        total[word] += n
    assert {w: n for w, n in total.items() if n >= 3} == plain_words([(3, text * 3)])


@pytest.mark.parametrize("bucket", [3, 64])
def test_variants_equal_brute_force(spark, bucket):
    draw = random.Random(5)
    words = {}
    for _ in range(300):
        words["".join(draw.choice("ab") for _ in range(draw.randint(5, 9)))] = draw.randint(3, 40)
    for i in range(120):  # one half shared by many words
        words["gemeinsam" + "".join(draw.choice("xyzé") for _ in range(draw.randint(3, 9)))] = draw.randint(3, 400)
    words |= {"a" * k: 2**k for k in range(5, 16)}  # a long chain of forms
    words |= {"z" * 300: 3, "z" * 301: 9, "z" * 299 + "y": 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variants(df, bucket)) == plain_variants(words)


def test_query_on_edge_rows(spark):
    rows = edge_rows(spark)
    assert found(spelling.variants(spelling.words(rows))) == plain_variants(plain_words(texts(rows)))


def test_nothing(spark):
    assert spelling.variants(spelling.words(empty_rows(spark))).count() == 0
