"""BPE against the public tokenizer library, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest

from harborline.llm import bpe
from harborline.llm.queries import QUERIES
from harborline.llm.tables import documents
from tests.llm.edge import ROWS, edge_rows, empty_rows, texts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def mine():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Bpe(file.read())


def test_query(spark, library):
    rows = QUERIES["op1_bpe"](spark, SF).collect()
    want = []
    for i, t in texts(documents(spark, SF)):
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((
            i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
        ))
    assert sorted(map(tuple, rows)) == sorted(want)


def test_random_texts(library, mine):
    rng = random.Random(1)
    letters = [*"abcdeΣσİé '12\x85\x1c\x0bÀ中😀​́　", "'s", "<|endoftext|>", "<|startoftext|>", "in", "the"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids, repr(text)
        assert mine.decode(mine.encode(text)) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_every_kind_of_letter(library, mine):
    for start in range(0, 0x110000, 997):
        text = " ".join(f"a{chr(c)}B {chr(c)}" for c in range(start, min(start + 40, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_long_words_and_a_full_cache(library, mine, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    text = "abcab" * 3000 + " one two three four five one two"
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_edge_rows_and_other_columns(spark, library):
    spec = bpe.load(spark, PATH)
    df = bpe.encode_decode(edge_rows(spark), spec)
    assert sorted(df.columns) == sorted([*edge_rows(spark).columns, "decoded"])
    rows = df.collect()
    assert len(rows) == len(ROWS) and {r.score for r in rows} == {"z"}
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode_decode(empty_rows(spark), spec).count() == 0
    two = bpe.decode(bpe.encode(edge_rows(spark), spec), spec).select("doc_id", "text", "ids", "decoded")
    assert sorted(map(str, two.collect())) == sorted(map(str, df.select("doc_id", "text", "ids", "decoded").collect()))
