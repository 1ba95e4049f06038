"""Compare a registered query with its SQL statement, row by row."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when names, row counts and all values agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(_plain(row[names.index(c)]) for c in order) for row in expected)
    got = Counter(tuple(_plain(row[c]) for c in order) for row in df.select(*order).collect())
    if want == got:
        return ""
    extra, lost = got - want, want - got
    return (
        f"{sum(got.values())} rows instead of {sum(want.values())}; {order}; "
        f"extra {list(extra.items())[:3]}; missing {list(lost.items())[:3]}"
    )
