"""Run a registered query and its SQL oracle on the same folder and compare rows exactly."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _sorted(rows):
    def key(row):
        return tuple((False, "", 0) if v is None else (True, str(type(v)), v) for v in row)

    return sorted(rows, key=key)


def compare(query, spark, con, folder: str) -> tuple[int, str]:
    """(row count, "" or a description of the first difference)."""
    df = query.run(spark, folder)
    names = sorted(df.columns)
    got = _sorted([tuple(r) for r in df.select(*names).collect()])
    if query.oracle is None:
        return len(got), ""
    cur = con.execute(query.sql())
    columns = [c[0] for c in cur.description]
    if sorted(columns) != names:
        return len(got), f"columns {names} and {sorted(columns)}"
    at = [columns.index(n) for n in names]
    want = _sorted([tuple(r[i] for i in at) for r in cur.fetchall()])
    if len(got) != len(want):
        return len(got), f"{len(got)} rows, oracle has {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return len(got), f"{dict(zip(names, a))} but oracle {dict(zip(names, b))}"
    return len(got), ""
