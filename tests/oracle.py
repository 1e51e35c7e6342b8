"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for entry in os.listdir(sf_dir):
        name = entry.split(".")[0]
        path = f"{sf_dir}/{entry}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{entry}") else "")
        con.sql(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql: str) -> None:
    made = con.sql(sql)
    assert sorted(df.columns) == sorted(made.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(made.columns, made.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
