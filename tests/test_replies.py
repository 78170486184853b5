"""The reply store and the packing of prompts."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from harborline.functions.running import with_position, with_running_total
from harborline.operators import enrich
from harborline.operators.replies import ReplyStore


def logging_client(folder, fail=()):
    """Counts calls in files, one a call, as tasks run elsewhere."""
    def factory():
        def client(prompt):
            with open(os.path.join(folder, os.urandom(8).hex()), "w") as file:
                file.write(prompt)
            if prompt in fail:
                raise ValueError("no answer")
            return json.dumps({"text": prompt.upper()})
        return client
    return factory


def calls(folder):
    return sorted(open(path).read() for path in glob.glob(f"{folder}/*"))


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


@pytest.fixture()
def places(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "store"), str(tmp_path / "calls")


def answers(df):
    return {r.id: r.reply for r in df.collect()}


def test_equal_prompts_are_asked_once_and_never_again(spark, places):
    path, log = places
    df = prompts(spark, ["a"] * 50 + ["b", "c", "B"])
    store = ReplyStore(spark, path, "m")
    first = answers(enrich.with_replies(df, F.col("text"), logging_client(log), store=store))
    assert calls(log) == ["B", "a", "b", "c"] and store.asked == 4
    assert first[0] == first[49] == '{"text": "A"}' and len(first) == 53
    again = ReplyStore(spark, path, "m")
    assert answers(enrich.with_replies(df, F.col("text"), logging_client(log), store=again)) == first
    assert again.asked == 0 and len(calls(log)) == 4
    assert answers(enrich.with_replies(df, F.col("text"), None, store=again)) == first  # answers without a client


def test_model_and_kind_are_part_of_the_prompt(spark, places):
    path, log = places
    df = prompts(spark, ["a"])
    for model, as_json in (("m", True), ("n", True), ("m", False)):
        store = ReplyStore(spark, path, model)
        enrich.with_replies(df, F.col("text"), logging_client(log), as_json=as_json, store=store)
        assert store.asked == 1


def test_a_failed_run_keeps_its_waves(spark, places):
    path, log = places
    texts = [f"t{i}" for i in range(40)]
    df = prompts(spark, texts)

    class Stop(BaseException):
        pass

    def breaking(client, prompt, as_json):
        if prompt == texts[7]:
            raise Stop
        return enrich.ask(client, prompt, as_json)

    store = ReplyStore(spark, path, "m", wave_prompts=5)
    with pytest.raises(Exception):
        store.answered(df, F.col("text"), logging_client(log), breaking)
    kept = store.replies().count()
    assert 0 < kept < 40 or store.waves == 0
    before = len(calls(log))
    resumed = ReplyStore(spark, path, "m", wave_prompts=5)
    result = answers(enrich.with_replies(df, F.col("text"), logging_client(log), store=resumed))
    assert resumed.asked == 40 - kept == len(calls(log)) - before
    assert result == {i: json.dumps({"text": t.upper()}) for i, t in enumerate(texts)}


def test_prompts_without_a_valid_answer_are_asked_by_the_next_run(spark, places, monkeypatch):
    path, log = places
    df = prompts(spark, ["good", "bad", None])
    store = ReplyStore(spark, path, "m")
    quick = lambda client, prompt, as_json: enrich.ask(client, prompt, as_json, sleep=lambda s: None)
    got = answers(store.answered(df.where("text IS NOT NULL"), F.col("text"), logging_client(log, fail=("bad",)), quick))
    assert got == {0: '{"text": "GOOD"}', 1: None}
    again = ReplyStore(spark, path, "m")
    assert answers(again.answered(df.where("text IS NOT NULL"), F.col("text"), logging_client(log), quick))[1] == '{"text": "BAD"}'
    assert again.asked == 1


def test_without_prompts(spark, places):
    path, log = places
    store = ReplyStore(spark, path, "m")
    assert enrich.with_replies(prompts(spark, []), F.col("text"), logging_client(log), store=store).count() == 0
    assert store.asked == 0 and calls(log) == []


# --- running totals and packing ----------------------------------------------


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_totals_and_positions(spark, partitions):
    rows = [(i, (i * 7919) % 100, i % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score int, size long").repartition(partitions)
    expected, total = {}, 0
    for place, (i, _, size) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        expected[i] = (place, total)
        total += size
    order = [F.desc("score"), F.asc("id")]
    placed = with_position(with_running_total(df, order, F.col("size"), "before"), order)
    assert {r.id: (r.rank, r.before) for r in placed.collect()} == expected


def test_running_totals_make_each_row_once(spark):
    """The bounds of the ranges are found on written rows: what the rows come from runs once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(500).repartition(5)
    placed = with_position(rows.mapInArrow(counted, rows.schema), [F.desc("id")])
    assert {r.id: r.rank for r in placed.collect()} == {i: 499 - i for i in range(500)}
    assert made.value == 500


def packed(notes, limit):
    """Items with their start in order to parts, by the rule: whole cells, and items across a border alone."""
    parts, start = [], 0
    for _, text in notes:
        size, cell = len(text) + 2, start // limit
        key = (cell, (start + size - 1) // limit > cell)
        if not parts or parts[-1][0] != key or key[1]:
            parts.append((key, []))
        parts[-1][1].append(text)
        start += size
    return ["\n\n".join(texts) for _, texts in parts]


@pytest.mark.parametrize("partitions", [1, 6])
def test_parts_are_bounded_and_do_not_depend_on_partitions(spark, partitions):
    notes = [(i, 1 + i % 3, "x" * ((i * 37) % 60)) for i in range(200)] + [(300, 1, "y" * 500), (301, None, "no account"), (302, 2, None)]
    df = spark.createDataFrame(notes, "ord long, matched_account_id long, raw_text string").repartition(partitions)
    limit = 100
    found = enrich.packed_texts(df, limit, by_account=True).where("account_id IS NOT NULL").collect()
    for account in (1, 2, 3):
        mine = [(o, t) for o, a, t in notes if a == account and t is not None]
        got = [r for r in sorted(found, key=lambda r: (r.account_id, r.part)) if r.account_id == account]
        assert [r.note_text for r in got] == packed(mine, limit)
        assert sum(r.note_count for r in got) == len(mine)
        assert all(len(r.note_text) <= limit or r.note_count == 1 for r in got)
    everything = [(o, t) for o, a, t in sorted(notes, key=lambda n: (n[1] is not None, n[1] or 0, n[0])) if t is not None]
    found = enrich.packed_texts(df, limit, by_account=False).collect()
    assert [r.note_text for r in sorted(found, key=lambda r: r.part)] == packed(everything, limit)


def test_prompts_reach_the_client_in_bounded_runs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(enrich, "SLICE_BYTES", 100)
    texts = ["x" * n for n in (10, 90, 1, 300, 40, 40, 40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], names=["id", "p"])
    runs = [part.column(1).to_pylist() for part in enrich._slices(batch, 1)]
    assert [t for run in runs for t in run] == texts
    assert all(len(run) == 1 or sum(len(t or "") for t in run) <= 100 for run in runs)


def test_only_carried_columns_go_with_a_prompt(spark):
    df = spark.createDataFrame([(i, "w" * i) for i in range(20)], "id long, text string")
    asked = enrich.with_replies(df, F.col("text"), lambda: lambda prompt: '"%d"' % len(prompt), carried=["id"])
    assert asked.columns == ["id", "reply"]
    assert {r.id: r.reply for r in asked.collect()} == {i: f'"{i}"' for i in range(20)}
    plain = enrich.with_replies(df, F.col("text"), None, carried=["id"])
    assert plain.columns == ["id", "reply"] and plain.count() == 20
