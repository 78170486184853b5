"""Decontamination against plain edit distance, toxicity on held-out rows, and the pipeline."""

import math
import random
import zlib

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import decontaminate as dc
from harborline.llm import toxicity
from harborline.llm.queries import QUERIES
from harborline.llm.tables import documents
from tests.llm.edge import ROWS, edge_rows, empty_rows, texts
from tests.llm.test_minhash import brute_classes

SF = "/root/testdata/sf0.001"


def plain_distance(pattern, text):
    """The least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]])
    return text


def test_matches_by_brute_force():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "of", "the", "on", "delta", "in", "epsilon"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 25)))) for i in range(12)]
    block = dc.Items(items, dc.ERROR_RATE)
    seen = 0
    for _ in range(150):
        i, item = rng.choice(items)
        around = [" ".join(rng.choices(words, k=rng.randint(0, 20))) for _ in range(2)]
        text = dc.normalised(f"{around[0]} {edited(rng, item, rng.randint(0, int(0.09 * len(item))))} {around[1]}")
        found = {m["item_id"]: m for m in block.matches(text)}
        for j, other in items:
            best = plain_distance(other, text)
            if best <= int(dc.ERROR_RATE * len(other)):
                assert found[j]["edits"] == best
                assert plain_distance(other, text[found[j]["start"] : found[j]["end"]]) == best
                seen += 1
            else:
                assert j not in found
    assert seen > 100


def test_decontaminate_edge_cases(spark, monkeypatch):
    item = "The quick, brown fox jumps over the lazy dog!"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "..."), (None, "orphan row without an id"), (4, "x")], "item_id long, text string")
    df = edge_rows(spark).withColumnRenamed("n_chars", "matches")
    once = {}
    for size in (1_000_000, 30):  # one block, and a block for each item
        monkeypatch.setattr(dc, "BLOCK_CHARS", size)
        rows = dc.with_matches(df, bench).collect()
        assert len(rows) == len(ROWS)
        once[size] = sorted((r.doc_id or -1, r.text or "", sorted((m.item_id or -1, m.edits) for m in r.matches)) for r in rows)
    assert once[30] == once[1_000_000]
    found = {t[:5]: m for _, t, m in once[30]}
    assert found["the q"] == [(1, 0), (1, 0), (4, 0)] and found["orpha"] == [(-1, 0)] and found["x"] == [(4, 0)] and found[""] == []
    assert dc.with_matches(empty_rows(spark), bench).count() == 0
    none = dc.with_matches(df, bench.limit(0)).collect()
    assert len(none) == len(ROWS) and not any(r.matches for r in none)


def test_decontaminate_query(spark):
    bench = [(r.item_id, dc.normalised(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: dc.normalised(t) for i, t in texts(documents(spark, SF))}
    found = {(r.doc_id, r.item_id): r for r in QUERIES["op6_decontaminate"](spark, SF).collect()}
    whole = {(d, i) for i, item in bench for d, t in docs.items() if item in t}
    assert whole <= set(found) and all(found[k].edits == 0 for k in whole)
    for (d, i), r in found.items():
        assert plain_distance(dict(bench)[i], docs[d][r.start : r.end]) == r.edits


def test_toxicity_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    rows = QUERIES["op9_toxicity"](spark, path)
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    found = [r for r in rows.join(labels, "doc_id").collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    good, bad = [r.score for r in found if r.toxic == 0], [r.score for r in found if r.toxic == 1]
    above = sum((g < b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert above > 0.93
    predicted = [r for r in found if r.predicted]
    assert sum(r.toxic for r in predicted) > 0.85 * len(predicted)
    assert all(r.predicted == (r.score >= 0.3) and r.rejected == (r.score >= r.threshold) for r in found)


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(edge_rows(spark), labels))
    rows = toxicity.score(edge_rows(spark), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.score) == pytest.approx(r.score, abs=2e-6)
    unlabelled = toxicity.train(toxicity.training_rows(empty_rows(spark), labels.limit(0)))
    assert {round(r.score, 6) for r in toxicity.score(edge_rows(spark), unlabelled).collect()} == {0}
    assert toxicity.score(empty_rows(spark), model).count() == 0


def test_a_repeated_id_does_not_exceed_the_training_limit(spark):
    rows = [(1, f"text {i // 2}", "en") for i in range(200)] + [(i, "other", "de") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, limit=50).count() == 50
    own = [(r.id, r.text) for r in toxicity.training_rows(docs, labels).collect()]
    assert len(own) == len(set(own)) and sum(i == 1 for i, _ in own) == 100


def test_scores_do_not_depend_on_the_batch():
    model = toxicity.Classifier()
    rows = [toxicity.buckets(t) for t in ("", "one", "one two", "a b c d e f g " * 50, "", "idiot")]
    together = model.scores(rows)
    assert [model.scores([r])[0] for r in rows] == pytest.approx(together.tolist(), abs=2e-6)


def test_pipeline_stages_by_brute_force(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    kept = corpus_pipeline.non_toxic(spark, docs, SF)
    assert kept.columns == columns
    rejected = {r.doc_id for r in QUERIES["op9_toxicity"](spark, SF).collect() if r.rejected}
    rows = [r for r in docs.collect() if r.doc_id not in rejected]
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows))

    best = {}
    for r in rows:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)
        best[key] = max(best.get(key, -1), r.doc_id)
    once = corpus_pipeline.without_copies(spark, docs, SF)
    assert once.columns == columns
    after = corpus_pipeline.without_copies(spark, spark.createDataFrame(rows, docs.schema), SF)
    assert {r.doc_id for r in after.collect()} == set(best.values())
    rows = [r for r in rows if r.doc_id in set(best.values())]

    near = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, docs.schema), SF)
    want = {c for _, c, _ in brute_classes([(r.doc_id, r.text) for r in rows])}
    assert {r.doc_id for r in near.collect()} == want and near.columns == columns
    rows = [r for r in rows if r.doc_id in want]

    leaks = {r.doc_id for r in QUERIES["op6_decontaminate"](spark, SF).collect()}
    clean = corpus_pipeline.without_benchmark(spark, spark.createDataFrame(rows, docs.schema), SF)
    rows = [r for r in rows if r.doc_id not in leaks]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} and clean.columns == columns

    result = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in result} == {r.doc_id for r in rows}
    tokens = {r.doc_id: r.ids_sha256 for r in QUERIES["op1_bpe"](spark, SF).collect()}
    assert all(tokens[r.doc_id] == r.ids_sha256 for r in result)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_edge_rows(spark, name, stage):
    rows = stage(spark, edge_rows(spark), SF)
    assert name == "bpe" or rows.columns == edge_rows(spark).columns
    count = rows.count()
    if name in ("toxicity", "decontaminate", "bpe"):
        assert count == len(ROWS)
    else:
        assert count == len({(t or "").lower() if name == "exact_dedup" else " ".join((t or "").lower().split()) for _, t, _ in ROWS})
    assert stage(spark, empty_rows(spark), SF).count() == 0


CLASHING = ("score", "matches", "_row", "threshold", "rejected", "_matches_0", "keep_0", "row", "digest", "label", "kept", "id")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, name, stage):
    """Columns named like those that the operators use come out with the values they went in with."""
    docs = documents(spark, SF).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select(*(F.lit(f"own {c} ") .alias(c) for c in CLASHING[:6]), "*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING[6:]))
    kept = stage(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert 0 < len(rows) <= docs.count()
    for r in rows:
        assert all(r[c] == f"own {c} " for c in CLASHING[:6]) and all(r[c] == f"{c}{r.doc_id}" for c in CLASHING[6:])


def plain_score(model, text):
    """The classifier's forward pass word by word, without batches or numpy sums."""
    rows = toxicity.buckets(text).tolist()
    words = len(rows) - max(toxicity.WIDTHS)
    vectors = [[float(model.table[a][d]) + float(model.table[b][d]) for d in range(toxicity.DIMENSIONS)] for a, b in rows]
    z, at = float(model.offset), 0
    for filters, bias in zip(model.filters, model.bias):
        for k in range(toxicity.FILTERS):
            best = max(
                sum(vectors[start + j][d] * float(filters[j][d][k]) for j in range(len(filters)) for d in range(toxicity.DIMENSIONS))
                for start in range(words + 1)
            )
            z += max(best + float(bias[k]), 0.0) * float(model.out[at])
            at += 1
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_forward_pass(spark):
    docs = documents(spark, SF).select("doc_id", "text", "lang")
    data = toxicity.train(toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    model = toxicity.Classifier.from_bytes(data)
    rows = toxicity.score(docs.union(edge_rows(spark).select("doc_id", "text", "lang")), data).select("text", "score").collect()
    short = sorted(rows, key=lambda r: len(r.text or ""))[:60]
    assert {r.text for r in short} >= {None, "", "x"}
    for r in short:
        assert r.score == pytest.approx(plain_score(model, r.text or ""), abs=2e-5)
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scores = {r.score for r in rows}
    assert labelled and min(scores) < 0.3 < max(scores)


def test_the_fit_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 3000)
    monkeypatch.setattr(toxicity, "TRAIN_TEXT_BYTES", 400)
    rows = spark.createDataFrame([(i, "w" * (i * 37 % 600), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    found = toxicity.training_rows(rows, labels).collect()
    assert found and max(len(r.text) for r in found) <= 400 and 2500 < sum(len(r.text) for r in found) <= 3000


def test_the_fit_reads_every_labelled_row(spark, monkeypatch):
    """Rows beyond one piece teach too: a word that marks toxic texts in a few of many rows is learned, and
    the pieces' order and number of partitions change nothing."""
    rows = [(i, ("vile " if i % 5 == 0 else "mild ") + f"word{i % 37} thing{i % 11}", "en") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 200)
    monkeypatch.setattr(toxicity, "TRAIN_TEXT_BYTES", 5)
    taught = toxicity.labelled_rows(docs, labels)
    assert taught.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1200)) > 3 * 200
    model = toxicity.train(taught)
    assert model == toxicity.train(toxicity.labelled_rows(docs.repartition(7), labels.repartition(3)))
    for r in toxicity.score(docs, model).collect():
        assert (r.score > 0.5) == (r.doc_id % 5 == 0) == r.rejected


def test_the_fit_moves_the_labelled_texts_once(spark, monkeypatch):
    """Texts without a label stay where they are before the fit, and the labelled ones are looked up once."""
    monkeypatch.setattr(toxicity, "KEY_BITS", 1 << 17)
    keys = spark.createDataFrame([(i,) for i in range(0, 3000, 3)] + [(None,)], "id long")
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(None, "none")], "id long, text string")
    passed = [r.id for r in toxicity.perhaps_in(rows, keys, "id").collect()]
    assert set(passed) >= set(range(0, 3000, 3)) and len(passed) == len(set(passed)) < 1100
    monkeypatch.setattr(toxicity, "KEY_BITS", 1)
    assert toxicity.perhaps_in(rows, keys, "id").where("id IS NOT NULL").count() == 3000

    read = spark.sparkContext.accumulator(0)
    taught = spark.createDataFrame([(i, f"word{i % 5}", "en", int(i % 5 == 0)) for i in range(100)], "id long, text string, lang string, toxic int")

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    toxicity.train(taught.mapInArrow(counted, taught.schema))
    assert read.value == 100


def test_ids_of_another_type_find_their_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(50)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id int, toxic int")
    want = {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {r.id for r in toxicity.labelled_rows(docs, labels).collect()} == want
    assert {r.id for r in toxicity.labelled_rows(docs, labels.withColumn("doc_id", F.col("doc_id").cast("long"))).collect()} == want
