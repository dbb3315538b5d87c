"""Compare a registered Spark query with its SQL twin, strictly and by value."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{round(v, 6):.6f}"
    return v


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    cols = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    for g, w in zip(got, want):
        if g != w:
            return f"{dict(zip(cols, g))} != {dict(zip(cols, w))} ({sum(a != b for a, b in zip(got, want))} of {len(got)} differ)"
    return None if got else "no rows"
