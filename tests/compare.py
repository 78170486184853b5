"""Order-insensitive comparison of a Spark query with its DuckDB oracle."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(columns, rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def differences(df, con, sql: str, show: int = 3) -> str | None:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(set(columns) ^ set(df.columns))}"
    want = rows_of(columns, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return None
    only_got = [r for r in got if r not in set(want)][:show]
    only_want = [r for r in want if r not in set(got)][:show]
    return f"{len(got)} rows against {len(want)}; spark only {only_got}; sql only {only_want}"
