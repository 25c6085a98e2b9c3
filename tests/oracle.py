"""Runs registered queries next to their SQL in DuckDB, as the driver does."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return str(x) if hasattr(x, "isoformat") else x


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in data), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str = SF, con=None) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = (con or connection(sf_dir)).execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"{name}: columns {sorted(got_names)} against {sorted(want_names)}"
    a, b = rows(got_names, got), rows(want_names, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"{name}: {len(a)} rows against {len(b)}, first differences {bad}"
    return ""
