"""Row-by-row comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, con, sql: str) -> str | None:
    """None when both give the same rows, else a short account."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    got = rows_of(df.columns, df.collect())
    want = rows_of(names, expected)
    if got == want:
        return None
    extra, missing = [r for r in got if r not in want][:3], [r for r in want if r not in got][:3]
    return f"{len(got)} rows instead of {len(want)}; extra {extra}; missing {missing}"
