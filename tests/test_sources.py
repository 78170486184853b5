import gzip

import pytest
from pyspark.sql import functions as F

from harborline.operators.nps import nps_summary
from harborline.sources.readers import read_accounts, read_all, read_csv, read_lenient, read_nps, read_tickets, read_usage
from harborline.sources.sinks import write_by_account, write_scores
from tests.conftest import by_key

FILES = {
    "accounts": "accounts.csv", "usage": "usage.csv", "tickets": "tickets.csv", "nps": "nps.csv",
    "csm_notes": "notes.txt", "changelog": "changelog.md",
}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "accounts.csv").write_text(
        "csm_name,account_id,account_name,plan_tier,industry,region,arr,contract_end_date,extra\n"
        "Raj Patel,1001, BrightPath Solutions ,Pro,Tech,EU,5000.50,2026-07-01,x\n"
        "Raj Patel,1002,\"Pinnacle, Systems\",Basic,Tech,EU,,2027-07-01,x\n")
    (tmp_path / "usage.csv").write_text(
        "account_id,month,api_calls,content_entries_created,active_users,workflows_triggered,sdk_version\n"
        + "".join(f"1001,2026-0{m},{100 - 20 * m},1,n/a,2,v3.1.2\n" for m in (4, 1, 3, 2)))
    (tmp_path / "tickets.csv").write_text(
        "ticket_id,account_id,created_date,priority,status,resolution_time_hours,subject,description\n"
        "7,1001,2026-05-01,p1,open,,SDK upgrade guidance,\"says \"\"recurring\"\"\"\n")
    (tmp_path / "nps.csv").write_text(
        "account_id,score,verbatim_comment\n1001,9,\n1001,8,N/A\n1002,10,None\n1001,7,too expensive\n")
    (tmp_path / "notes.txt").write_text(
        "CSM Call Notes\n---\nacct 1001 - x\nVP joined the call\n---\nTalked to pinacle systems, no show\n")
    (tmp_path / "changelog.md").write_text("# v1\n\nline\n")
    return {k: str(tmp_path / v) for k, v in FILES.items()}


def test_read_all(spark, folder):
    data = read_all(spark, folder)
    accounts = by_key(data["accounts"])
    assert accounts[1001].account_name == "BrightPath Solutions" and accounts[1001].in_renewal_window
    assert accounts[1002].account_name == "Pinnacle, Systems" and accounts[1002].arr is None
    assert str(accounts[1001].arr) == "5000.50"
    months = [r.month for r in data["usage"].orderBy("month_dt").collect()]
    assert months == ["2026-01", "2026-02", "2026-03", "2026-04"]
    assert data["usage"].first().active_users is None
    assert data["tickets"].first().description == 'says "recurring"'
    assert by_key(nps_summary(data["nps"]))[1001].score == 7  # the last line counts
    assert [r.verbatim_comment for r in data["nps"].orderBy("ord").collect()] == ["", "", "", "too expensive"]
    assert [r.account_id for r in data["csm_notes"].orderBy("ord").collect()] == [1001, None]
    assert [r.line for r in data["changelog"].orderBy("ord").collect()] == ["# v1", "", "line"]
    assert data["changelog_events"].count() == 8


def test_position_counts_across_many_splits(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"p{part}.csv").write_text("n\n" + "".join(f"{part * 1000 + i}\n" for i in range(1000)))
    for key, value in (("spark.sql.files.maxPartitionBytes", "700"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(key, value)
    try:
        rows = read_csv(spark, str(tmp_path)).collect()
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    assert sorted((r.ord, int(r.n)) for r in rows) == [(i, i) for i in range(3000)]


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "u.csv").write_text('account_id,score,verbatim_comment\n1,9,"two\nlines"\n2,3,x\n')
    assert read_csv(spark, str(tmp_path / "u.csv"), multi_line=True).count() == 2


def test_usage_without_version_column(spark, tmp_path):
    (tmp_path / "u.csv").write_text(
        "account_id,month,api_calls,content_entries_created,active_users,workflows_triggered\n1,2026-01,1,1,1,1\n")
    assert read_usage(spark, str(tmp_path / "u.csv")).first().sdk_version == "unknown"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "High", 3), (2, "Low", 1), (1, "High", 2)], "account_id int, risk_tier string, ord int")
    write_scores(df, str(tmp_path / "scores"))
    back = spark.read.parquet(str(tmp_path / "scores"))
    assert back.where(F.col("risk_tier") == "High").count() == 2
    write_by_account(df, str(tmp_path / "rows"), ["ord"])
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 3


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    """Other orders, missing optional columns, additional ones, packed files; positions over all files."""
    (tmp_path / "a.csv").write_text("account_id,month,api_calls,content_entries_created,active_users,workflows_triggered,sdk_version\n1,2026-01,5,1,2,3,v4\n1,2026-02,6,1,2,3,\n")
    (tmp_path / "b.csv").write_text("active_users,month,account_id,workflows_triggered,api_calls,content_entries_created\n20,2026-03,2,30,50,10\n")
    (tmp_path / "c d.csv").write_text("\ufeffmonth,account_id,extra,api_calls,\"content_entries_created\",active_users,workflows_triggered,sdk_version\n2026-04,3,x,7,8,9,10,v5\n")
    (tmp_path / "e.csv").write_text("")
    with gzip.open(tmp_path / "f.csv.gz", "wt") as file:
        file.write("active_users,month,account_id,workflows_triggered,api_calls,content_entries_created\n21,2026-05,2,31,51,11\n")
    rows = read_usage(spark, str(tmp_path)).orderBy("ord").collect()
    found = [(r.ord, r.account_id, r.month, r.api_calls, r.content_entries_created, r.active_users, r.workflows_triggered, r.sdk_version) for r in rows]
    assert found == [
        (0, 1, "2026-01", 5, 1, 2, 3, "v4"), (1, 1, "2026-02", 6, 1, 2, 3, None), (2, 2, "2026-03", 50, 10, 20, 30, "unknown"),
        (3, 3, "2026-04", 7, 8, 9, 10, "v5"), (4, 2, "2026-05", 51, 11, 21, 31, "unknown"),
    ]
    assert [r.extra for r in rows] == [None, None, None, "x", None]


def test_headers_that_cannot_be_read_raise(spark, tmp_path):
    (tmp_path / "n.csv").write_text("account_id,verbatim_comment\n1,x\n")
    with pytest.raises(ValueError, match="lacks score"):
        read_nps(spark, str(tmp_path))
    (tmp_path / "n.csv").write_text("account_id,score,score\n1,2,3\n")
    with pytest.raises(ValueError, match="twice"):
        read_nps(spark, str(tmp_path))


BAD = {
    "accounts": ("account_id,account_name,plan_tier,arr,contract_end_date\n1,a,Pro,5.5,2026-07-01\nx,b,Pro,many,2026-13-01\n3,c,Pro,,\n4,d\n5,e,Pro,1,2026-07-01,more\n",
                 [(1, "account_id", "x", "not a bigint"), (1, "arr", "many", "not a decimal"), (1, "contract_end_date", "2026-13-01", "not a date"),
                  (3, None, "4,d", "does not fit the header"), (4, None, "5,e,Pro,1,2026-07-01,more", "does not fit the header")], [1, 3]),
    "usage": ("account_id,month,api_calls,content_entries_created,active_users,workflows_triggered\n1,2026-01,n/a,bad,1,1\n2,26/01,1,1,1,1\n",
              [(1, "month", "26/01", "not a month")], [1]),
    "tickets": ("account_id,created_date,priority,status,resolution_time_hours\n1,2026-05-01 10:00:00,p1,open,\n2,soon,p1,open,2\n3,,p1,open,long\n4,,p2,open,1.5\n",
                [(1, "created_date", "soon", "not a timestamp"), (2, "resolution_time_hours", "long", "not a double")], [1, 4]),
    "nps": ("account_id,score\n1,9\n2,ten\n3,\n", [(1, "score", "ten", "not a double")], [1, 3]),
}
STRICT = {"accounts": read_accounts, "usage": read_usage, "tickets": read_tickets, "nps": read_nps}


@pytest.mark.parametrize("kind", sorted(BAD))
def test_lenient_reading_sets_bad_records_aside(spark, tmp_path, kind):
    text, bad, ids = BAD[kind]
    (tmp_path / "in.csv").write_text(text)
    rows, rejects = read_lenient(spark, kind, str(tmp_path))
    assert sorted(r.account_id for r in rows.collect()) == ids
    assert rows.where("account_id = 1").count() == 1  # a pushed filter meets no bad value
    found = rejects.collect()
    assert sorted((r.position, r.column or "", r.raw_text, r.reason) for r in found) == sorted((p, c or "", t, w) for p, c, t, w in bad)
    assert all(r.file.endswith("in.csv") for r in found)
    assert rows.count() + len({r.position for r in found}) == text.count("\n") - 1
    if any(c for _, c, _, _ in bad):
        with pytest.raises(Exception):
            STRICT[kind](spark, str(tmp_path)).collect()


def test_lenient_reading_of_good_files_equals_strict_reading(spark, folder):
    for kind in BAD:
        rows, rejects = read_lenient(spark, kind, folder[kind])
        strict = STRICT[kind](spark, folder[kind])
        assert rejects.count() == 0
        assert sorted(map(str, rows.select(*strict.columns).collect())) == sorted(map(str, strict.collect()))
