"""Heavy keys, digests and stored pages."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from harborline.functions.digest import sum_digest
from harborline.functions.heavy import heavy_values, lookup
from harborline.operators.reconcile import reconcile_notes
from harborline.plans import account_store
from harborline.sources.sinks import write_by_account


def most_in_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


@pytest.fixture()
def plain_shuffles(spark):
    """Sort-merge joins as they are, without size-based broadcasts or adaptive splits."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_heavy_values_are_exact(spark):
    df = spark.createDataFrame([(i % 7 if i < 700 else i,) for i in range(2000)], "key long").repartition(5)
    assert {r.key for r in heavy_values(df, "key", 0.04).collect()} == set(range(7))
    assert heavy_values(df, "key", 0.06).count() == 0
    assert heavy_values(df.limit(0), "key").count() == 0


def test_lookup_equals_a_left_join_and_spreads_heavy_keys(spark, plain_shuffles):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 500}" if i % 2 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, key string").repartition(12)
    table = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 500, 3))], "key string, value long")
    found = lookup(df, table, "key")
    want = df.join(table, "key", "left")
    assert Counter(map(tuple, found.select("id", "key", "value").collect())) == Counter(map(tuple, want.select("id", "key", "value").collect()))
    keyed = found.where("key IS NOT NULL")
    assert most_in_a_task(keyed) < 600 < 2000 <= most_in_a_task(want.where("key IS NOT NULL"))


def test_a_name_of_a_third_of_all_notes_meets_in_no_task(spark, plain_shuffles):
    accounts = spark.createDataFrame([(i, f"Account Number {chr(97 + i % 26)}{chr(97 + i // 26)} Works", i) for i in range(40)], "account_id long, account_name string, ord long")
    notes = [
        (i, 7 if i % 3 == 0 else None, "account number bb works" if i % 3 == 1 else None if i % 5 else f"nobody {i}", f"text {i}")
        for i in range(1500)
    ]
    df = spark.createDataFrame(notes, "ord long, account_id long, account_name_raw string, raw_text string").repartition(12)
    found = reconcile_notes(df, accounts)
    rows = {r.ord: r for r in found.collect()}
    assert len(rows) == 1500
    for i, r in rows.items():
        if i % 3 == 0:
            assert (r.matched_account_id, r.match_method) == (7, "id_direct")
        elif i % 3 == 1:
            assert (r.matched_account_id, r.match_method) == (27, "fuzzy_name")
    assert most_in_a_task(found) < 500


def test_digests_do_not_depend_on_order_but_on_rows(spark):
    def digest(texts, partitions):
        df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(partitions)
        return df.agg(sum_digest(F.col("t")).alias("d")).first().d

    assert digest(["a", "b", "b", "é"], 1) == digest(["b", "é", "a", "b"], 4)
    assert len({digest(x, 2) for x in (["a"], ["a", "a"], ["b"], ["a", "b"], ["ab"])}) == 5


def scanned_rows(df):
    """Rows that the file scans of a plan have read."""
    df.collect()
    plan, rows = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            rows.append(node.metrics().apply("numOutputRows").value())
        children = node.children() if not node.nodeName().endswith("QueryStage") else None
        plan += [children.apply(i) for i in range(children.size())] if children is not None else [node.plan()]
    return sum(rows)


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    rows = spark.range(400_000).select((F.col("id") % 20_000).alias("account_id"), F.col("id").alias("ord"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    path = str(tmp_path / "rows")
    write_by_account(rows, path, ["ord"], row_group_bytes=256 * 1024)
    one = spark.read.parquet(path).where(F.col("account_id") == 777)
    assert one.count() == 20
    assert scanned_rows(spark.read.parquet(path).where(F.col("account_id") == 777)) < 20_000
    assert scanned_rows(spark.read.parquet(path).where(F.col("account_id") == 20_001)) == 0


def test_pages_are_the_rows_of_the_account(spark, tmp_path):
    from workload.fixtures import Inputs

    i = Inputs(spark, "/root/testdata/sf0.001")
    notes = i.known_notes.withColumns({"match_method": F.lit("known"), "match_confidence": F.lit(100.0)})
    account_store.write_pages(str(tmp_path / "pages"), i.scored, i.usage, i.tickets, notes, i.cfg)
    page = account_store.read_page(spark, str(tmp_path / "pages"), 5)
    assert page["header"].first().account_id == 5 and page["header"].count() == 1
    assert page["tickets"].count() == i.tickets.where("account_id = 5 AND priority IN ('P1','P2','P3','P4')").count()
    assert [r["rank"] for r in page["breakdown"].collect()] == list(range(1, page["breakdown"].count() + 1))
    assert page["notes"].select("raw_text").collect() == notes.where("matched_account_id = 5").select("raw_text").collect()
    assert account_store.page_rows(page).count() == sum(df.count() for df in page.values())
    assert account_store.page_rows(account_store.read_page(spark, str(tmp_path / "pages"), -1)).count() == 0
