"""BPE encoding and decoding of whole texts with a published vocabulary.

A word is a doubly linked list of symbols. A priority queue holds the merge ranks of
neighbouring pairs; the lowest rank, then the leftmost pair, merges first, and an entry whose
pair has changed since it was queued is skipped as stale. Decoding concatenates the strings of
the vocabulary, with one blank between tokens where the tokenizer names no decoder.

The vocabulary file is a parameter. The driver reads it and ships it by broadcast; its size is
that of the file and is checked against ``MAX_VOCABULARY_BYTES``.

Defined results: a null or empty text has no ids and decodes to the empty text. Texts of any
length are encoded whole. Rows are independent, so repeated rows give equal results; all other
columns pass through, and the two new columns replace columns of the same name.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from harborline.llm.tables import add_columns

MAX_VOCABULARY_BYTES = 64 * 1024 * 1024
#: Words whose ids one Python worker remembers; then it starts anew.
CACHED_WORDS = 150_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: a byte
    that prints in Latin-1 stands for itself, the others take characters from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


# Fixed values. Code points on which the Unicode tables of the tokenizers library differ from
# those of the regex module: these letters and numbers count as symbols there, ...
NEWER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7cf\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a"
    "\\U00011db0-\\U00011ddb\\U00011df1\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff"
    "\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2"
    "\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96"
    "\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed"
    "\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
# ... and these capitals have small letters there that Python's str.lower does not know.
NEWER_SMALL = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


class Bpe:
    """The tokenizer that a vocabulary file describes."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        steps = data["normalizer"]["normalizers"]
        split, level = data["pre_tokenizer"]["pretokenizers"]
        known = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
            and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
            and model["type"] == "BPE" and data["decoder"] is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        )
        if not known:
            raise ValueError("this vocabulary file asks for steps that are not built")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids = self.vocabulary
        #: by the id of the left symbol: the right symbol's id to the rank of the merge
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
        self.merged_id: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left]][ids[right]] = rank
            self.merged_id.append(ids[left + right])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for string, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = string
        symbols = byte_symbols()
        self.inner = [ids.get(x) for x in symbols]
        self.final = [ids.get(x + self.suffix) for x in symbols]
        # The Replace step only unites white space, which no word contains.
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        newer = NEWER_LETTERS
        self.newer = regex.compile(f"[{newer}{''.join(map(chr, NEWER_SMALL))}]").search
        plain = pattern.replace("[\\p{L}]", f"[\\p{{L}}--[{newer}]]").replace("[\\p{N}]", f"[\\p{{N}}--[{newer}]]")
        plain = plain.replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{newer}]]")
        self.words_with_newer = regex.compile(plain, regex.V1).findall
        found = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, found)) + ")").split if found else None
        self.cache = _Words(self)

    def merged(self, word: str) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit integers."""
        letters = word.encode()
        inner, ranks, merged_id = self.inner, self.ranks, self.merged_id
        ids = [inner[b] for b in letters]
        ids[-1] = self.final[letters[-1]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        queue = []
        left = ids[0] if ids else 0
        for at in range(1, n):
            right = ids[at]
            rank = ranks[left].get(right)
            if rank is not None:
                queue.append(rank << 40 | at - 1)  # ordered by rank, then by place
            left = right
        if queue:
            heapify(queue)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while queue:
                entry = heappop(queue)
                rank, at = entry >> 40, entry & 0xFFFFFFFFFF
                right = after[at]
                if ids[at] < 0 or right >= n or ranks[ids[at]].get(ids[right]) != rank:
                    continue  # stale: one of the pair has merged since
                ids[at] = new = merged_id[rank]
                ids[right] = -1
                after[at] = right = after[right]
                if right < n:
                    before[right] = at
                    rank = ranks[new].get(ids[right])
                    if rank is not None:
                        heappush(queue, rank << 40 | at)
                left = before[at]
                if left >= 0:
                    rank = ranks[ids[left]].get(new)
                    if rank is not None:
                        heappush(queue, rank << 40 | left)
            ids = [i for i in ids if i >= 0]
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:
            # Letter by letter, so a final sigma has no form of its own.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if self.newer(text):
                return b"".join(map(self.cache.__getitem__, self.words_with_newer(text.translate(NEWER_SMALL))))
        return b"".join(map(self.cache.__getitem__, self.words(text)))

    def encode(self, text: str) -> bytes:
        if self.specials is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(
            np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part)
            for part in self.specials(text)
        )

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Words(dict):
    """Remembers the ids of words, a bounded number of them."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.bpe.merged(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


_built: dict[int, Bpe] = {}


def _bpe(spec: Broadcast) -> Bpe:
    key = hash(spec.value)
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(spec.value)
    return _built[key]


def load(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file as a broadcast; its size is checked first."""
    with open(path, encoding="utf-8") as file:
        spec = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    return spark.sparkContext.broadcast(spec)


def encode(df: DataFrame, spec: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text as binary: little-endian unsigned 32-bit integers."""

    def encoded(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = _bpe(spec)
        return [pa.array([bpe.encode(t) if t else b"" for t in batch.column(text).to_pylist()], pa.binary())]

    return add_columns(df, encoded, f"`{ids}` binary", text)


def decode(df: DataFrame, spec: Broadcast, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of each binary list of ids; null ids give the empty text."""

    def text_of_ids(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = _bpe(spec)
        return [pa.array([bpe.decode(x) if x else "" for x in batch.column(ids).to_pylist()], pa.string())]

    return add_columns(df, text_of_ids, f"`{decoded}` string", ids)


def encode_decode(df: DataFrame, spec: Broadcast, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both columns in one pass, so that the ids go through one Python worker only."""

    def both(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = _bpe(spec)
        found = [bpe.encode(t) if t else b"" for t in batch.column(text).to_pylist()]
        return [pa.array(found, pa.binary()), pa.array([bpe.decode(x) for x in found], pa.string())]

    return add_columns(df, both, f"`{ids}` binary, `{decoded}` string", text)
