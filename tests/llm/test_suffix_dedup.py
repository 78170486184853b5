"""Removal of repeated bytes against plain counting of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from harborline.llm import suffix_dedup as sd
from harborline.llm.queries import QUERIES
from harborline.llm.tables import documents
from tests.llm.edge import ROWS, edge_rows, empty_rows, texts


def brute(rows):
    data = [t.encode() for _, t in rows]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for (i, _), d in zip(rows, data):
        mask = bytearray(len(d))
        for a in range(len(d) - 199):
            if seen[d[a : a + 200]] > 1:
                mask[a : a + 200] = b"\1" * 200
        spans = sum(m and not (p and mask[p - 1]) for p, m in enumerate(mask))
        kept = bytes(c for c, m in zip(d, mask) if not m)
        out.append((i, len(d), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found(df):
    return Counter(
        (r.id, r.n_bytes, r.n_removed, len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sd.remove_repeats(df).collect()
    )


def test_query_by_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = QUERIES["op3_suffix_dedup"](spark, path).collect()
    want = brute(texts(documents(spark, path)))
    assert Counter(map(tuple, rows)) == want and sum(n for _, _, n, _, _ in want) > 0


def tricky(n, seed):
    """Texts with shared passages at random places, periods, copies and near copies."""
    rng = random.Random(seed)
    letter = lambda k: "".join(rng.choice("abcdéf \n\0") for _ in range(k))
    passages = [letter(rng.choice([150, 190, 199, 200, 201, 230, 450])) for _ in range(6)] + ["a" * 600, "xy" * 300]
    rows = []
    for i in range(n):
        parts = [rng.choice([letter(rng.randint(0, 300)), rng.choice(passages)]) for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if rng.random() < 0.2 and rows:
            text = rows[-1][1][:-1] + "!"
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_tricky_texts(spark, seed):
    rows = tricky(120, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(rows)


def _locally(rows, blocks, shards):
    """The same steps without Spark, so that small settings hold in every step."""
    import pyarrow as pa

    tables = [
        pa.Table.from_batches([sd._block_row(n, [i for i, _ in part], [t.encode() for _, t in part])])
        for n, part in enumerate(rows[k::blocks] for k in range(blocks))
    ]

    def answered(asked, keys):
        asked = pa.concat_tables(asked)
        groups = sorted(set(zip(*(asked.column(k).to_pylist() for k in keys))))
        columns = [asked.column(k).to_numpy() for k in keys]
        return [sd.answer(asked.filter(pa.array(np.all([c == x for c, x in zip(columns, g)], axis=0)))) for g in groups]

    of_block = lambda t, n: t.filter(pa.array(t.column("block").to_numpy() == n))
    asked = [pa.Table.from_batches(list(sd.ask_anchors(shards)(t.to_batches()))) for t in tables if len(t.column("hashes")[0].as_py())]
    anchors = pa.concat_tables(answered(asked, ["shard"]))
    more = answered([sd.ask_windows(shards)(t, of_block(anchors, n)) for n, t in enumerate(tables)], ["kind", "shard"])
    both = pa.concat_tables([anchors, *more])
    out = Counter()
    for n, t in enumerate(tables):
        for r in sd.without_repeats(shards)(t, of_block(both, n)).to_pylist():
            out[(r["id"], r["n_bytes"], r["n_removed"], len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest())] += 1
    return out, both.column("kind").to_pylist()


@pytest.mark.parametrize("hot, batch, step", [(128, 500, 1 << 19), (128, 3000, 400), (2, 1000, 300), (1, 1000, 1 << 19)])
def test_settings_do_not_change_the_result(monkeypatch, hot, batch, step):
    monkeypatch.setattr(sd, "HOT_BLOCKS", hot)
    monkeypatch.setattr(sd, "BATCH_BYTES", batch)
    monkeypatch.setattr(sd, "STEP", step)
    rows = tricky(100, 3)
    got, kinds = _locally(rows, 6, 4)
    assert got == brute(rows)
    assert (3 in kinds) == (hot < 6)


def test_family_levels_grow_geometrically():
    rng = np.random.default_rng(5)
    pool = [rng.integers(0, 3, 260).astype(np.uint8) for _ in range(40)]
    picks = rng.integers(0, 40, 64)
    family, want = sd.Family(64 * 61), Counter(bytes(pool[p][i : i + 200]) for p in picks for i in range(61))
    for n, p in enumerate(picks):
        family.add(pool[p], np.arange(61), np.arange(61) + n * 61)
    assert family.repeated.tolist() == [want[bytes(pool[p][i : i + 200])] > 1 for p in picks for i in range(61)]
    sizes = [len(level[1]) for level in family.levels]
    assert len(sizes) <= 7 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_edge_rows(spark):
    assert found(edge_rows(spark)) == brute([(i, t or "") for i, t, _ in ROWS])
    assert sd.remove_repeats(empty_rows(spark)).count() == 0
    assert found(edge_rows(spark).where("doc_id in (4, 7, 9)")) == brute([(4, ""), (7, " \t\n "), (9, "x")])


@pytest.mark.parametrize("hot", [128, 0])
def test_memory_is_bounded_if_all_windows_repeat(monkeypatch, hot):
    """A worker's peak for a block whose windows all occur twice, by segments and by hashes."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(sd, "HOT_BLOCKS", hot)
    monkeypatch.setattr(sd, "STEP", 1 << 16)
    text = bytes(np.random.default_rng(1).integers(97, 123, 1 << 20).astype(np.uint8))
    texts = [text[i : i + 4096] for i in range(0, len(text), 4096)] * 2
    size, peaks = 2 * len(text), {}

    def measured(name, f):
        tracemalloc.start()
        out = f()
        peaks[name] = tracemalloc.get_traced_memory()[1] / size
        tracemalloc.stop()
        return out

    block = pa.Table.from_batches([sd._block_row(0, list(range(len(texts))), texts)])
    anchors = sd.answer(pa.concat_tables([pa.Table.from_batches([b]) for b in sd.ask_anchors(1)(block.to_batches())]))
    asked = measured("ask", lambda: sd.ask_windows(1)(block, anchors))
    # A hash counts once for a block, so it is 17 bytes for a window of one of the two copies.
    assert hot or asked.nbytes < 18 * size / 2
    answers = measured("answer", lambda: sd.answer(asked))
    cut = measured("cut", lambda: sd.without_repeats(1)(block, pa.concat_tables([anchors, answers])))
    assert sum(cut.column("n_removed").to_pylist()) == size
    assert max(peaks.values()) < 25, peaks


def test_memory_of_a_shard_of_near_copies_is_bounded():
    import tracemalloc

    import pyarrow as pa

    text = bytes(np.random.default_rng(2).integers(97, 123, 1 << 20).astype(np.uint8))
    texts = [text[i : i + 500] + bytes([65 + copy]) + text[i + 500 : i + 1000] for copy in range(4) for i in range(0, len(text), 1000)]
    block = pa.Table.from_batches([sd._block_row(0, list(range(len(texts))), texts)])
    anchors = sd.answer(pa.concat_tables([pa.Table.from_batches([b]) for b in sd.ask_anchors(1)(block.to_batches())]))
    asked = sd.ask_windows(1)(block, anchors)
    tracemalloc.start()
    answers = sd.answer(asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    cut = sd.without_repeats(1)(block, pa.concat_tables([anchors, answers]))
    assert Counter(zip(cut.column("n_bytes").to_pylist(), cut.column("n_removed").to_pylist()))[(1001, 1000)] > 4000


def test_row_groups_of_blocks_are_few_rows(spark, monkeypatch):
    from pyarrow import parquet
    from pyspark.sql import functions as F

    class Written(Exception):
        pass

    def stop(*args, original=sd.written, **options):
        raise Written(original(*args, **options))

    monkeypatch.setattr(sd, "written", stop)
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(128)), lambda x: F.sha2(F.concat_ws(" ", "id", x.cast("string")), 256)))
    texts = spark.range(0, 6500, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    with pytest.raises(Written) as raised:
        sd.remove_repeats(texts)
    files = [parquet.ParquetFile(f.removeprefix("file://")) for f in raised.value.args[0].inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(groups) == 7 and max(groups) <= 3
