"""The prefix trie of conversations against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest

from harborline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, part string, depth string, a string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "d", "a") for r in rows], SCHEMA).repartition(5)


def by_place(role, text):
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, *by_place(role or "", text or ""), role or "", text or ""))
    own = {c: [t[-2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    children, sums = defaultdict(int), defaultdict(lambda: [0, 0])
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        saved = (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            sums[path[:d]][0] += children[path] == 0
            sums[path[:d]][1] += saved
    first = {path: min(c for c, _ in convs) for path, convs in members.items()}
    return sorted(
        (first[p], len(p), first[p[:-1]] if p else -1, len(cs), children[p], *sums[p],
         hashlib.sha256(",".join(map(str, sorted(c for c, end in cs if end))).encode()).hexdigest())
        for p, cs in members.items()
    )


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


def conversations():
    draw = random.Random(3)
    rows = []
    for c in range(120):  # few texts, so prefixes are shared; a third of the conversations are equal
        texts = ["same"] * 3 if c % 3 == 0 else [draw.choice(["é", "bb", "", "ccc"]) for _ in range(draw.randint(1, 12))]
        rows += [(c, i, draw.choice("ua") if c % 7 == 0 else "u", t) for i, t in enumerate(texts)]
    rows += [(c, i, "u", f"{i % 9}") for c in (1000, 1001, 1002, 1007) for i in range(600 + c % 10)]  # long ones, and hot
    return rows


@pytest.mark.parametrize("bound", [40, 50_000])
def test_nodes_equal_brute_force(spark, bound):
    rows = conversations()
    assert found(prefix_trie.trie_nodes(frame(spark, rows), bound)) == plain(rows)


def test_edge_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (3, None, None, None), (3, None, "user", "b"), (3, 1, "user", "a"),
        (3, 1, "user", "a"), (3, 1, "assistant", "a"), (4, 0, "user", "x" * 100_000), (9, 0, "user", "x" * 100_000),
        (10**17, 5, "system", "far"), (11, 2, "uᵘ", "é😀"), (11, 1, "", ""),
    ]
    assert found(prefix_trie.trie_nodes(frame(spark, rows))) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    turnless = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:20]
    rows = [(c, 0, "user", "only turn") for c in turnless]
    result = found(prefix_trie.trie_nodes(frame(spark, rows)))
    assert result == plain(rows) and len(result) == 1 and result[0][3] == 20


def test_nothing(spark):
    assert prefix_trie.trie_nodes(frame(spark, []).where("false")).count() == 0
    assert prefix_trie.trie_nodes(frame(spark, [(None, 0, "user", "x")])).count() == 0


def test_components_are_taken_apart_to_subtree_sums():
    draw = random.Random(8)
    for n in (1, 2, 7, 300):
        for deep in (1, 3, n):
            parents = [-1] + [draw.randint(max(0, v - deep), v - 1) for v in range(1, n)]
            weights = [draw.randint(1, 5) for _ in range(n)]
            values = [draw.randint(0, 9) for _ in range(n)]
            below, sums = list(weights), list(values)
            for v in range(n - 1, 0, -1):
                below[parents[v]] += below[v]
                sums[parents[v]] += sums[v]
            assert prefix_trie.taken_apart(parents, below, values, [1] * n)[0] == sums


@pytest.mark.parametrize("piece, batch", [(1, 1), (3, 2), (3, 100), (8192, 7)])
def test_pieces_of_ids_give_the_digest_of_the_whole_list(monkeypatch, piece, batch):
    """Lists cut into pieces and batches anywhere, even pieces of a node on both sides of a batch's end."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    nodes = {(d, d * 7, -d): list(range(d, 5 * d, d)) + [10**15 + d] for d in (1, 2, 5, 30)}
    nodes[(40, 1, 1)] = [-3]
    rows = [(*node, i) for node, ids in sorted(nodes.items()) for i in sorted(ids)]

    def batches(rows, names):
        for at in range(0, len(rows), batch):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + batch])], names=names)

    names = ["depth", "a", "b"]
    pieces = [tuple(r.values()) for b in prefix_trie._pieces(batches(rows, [*names, "conv_id"])) for r in b.to_pylist()]
    assert max(p[4].count(",") for p in pieces) < piece
    found = {(r["depth"], r["a"], r["b"]): r["ends_sha256"] for b in prefix_trie._digests(batches(sorted(pieces), [*names, "first", "piece"])) for r in b.to_pylist()}
    assert found == {n: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() for n, ids in nodes.items()}


@pytest.mark.parametrize("cut", [1, 2, 5, 17, 40])
def test_sequences_go_on_in_the_next_partition(monkeypatch, cut):
    """The numbers and hashes of turns do not depend on where the sorted turns are cut into partitions."""
    draw = random.Random(1)
    rows = sorted((draw.choice([1, 1, 1, 2, 9]), i, draw.getrandbits(60), draw.getrandbits(60)) for i in range(40))

    def table(cut):
        parts = []
        for part, at in enumerate(range(0, 40, cut)):
            monkeypatch.setattr(prefix_trie.TaskContext, "get", lambda part=part: type("T", (), {"partitionId": lambda self: part})())
            own = [(r[0], r[2], r[3], 1) for r in rows[at : at + cut]]
            batch = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*own[k : k + 3])], names=["conv_id", "x", "y", "bytes"]) for k in range(0, len(own), 3)]
            parts += prefix_trie._in_sequence(iter(batch))
        return parts

    class Collected:
        """As much of a DataFrame as the carries need."""

        def __init__(self, batches):
            self.rows = [r for b in batches for r in b.to_pylist()]

        def groupBy(self, key):  # noqa: N802
            return self

        def agg(self, *_):
            return self

        def collect(self):
            out = []
            for part in sorted({r["part"] for r in self.rows}):
                own = [r for r in self.rows if r["part"] == part]
                last = max(own, key=lambda r: (r["conv_id"], r["depth"]))
                out.append(SimpleNamespace(part=part, first=min(r["conv_id"] for r in own), last=SimpleNamespace(**last)))
            return out

    whole = [r for b in table(40) for r in b.to_pylist()]
    monkeypatch.setattr(prefix_trie.F, "min", lambda c: SimpleNamespace(alias=lambda n: c))
    monkeypatch.setattr(prefix_trie.F, "max", lambda c: SimpleNamespace(alias=lambda n: c))
    monkeypatch.setattr(prefix_trie.F, "struct", lambda *c: c)
    batches = table(cut)
    carried = prefix_trie._carried(Collected(batches))
    found = [r for b in prefix_trie._continued(carried)(iter(batches)) for r in b.to_pylist()]
    strip = lambda rows: [{k: v for k, v in r.items() if k != "part"} for r in rows]
    assert strip(found) == strip(whole)
