"""Compare a query with its SQL in DuckDB: equal columns, and equal rows in any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pathlib import Path


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'; SET threads = 2")
    for p in Path(sf_dir).glob("*.parquet"):
        place = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{place}'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def difference(df, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if they agree, else what differs."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    wanted = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if wanted == got:
        return ""
    return f"{(got - wanted).total()} rows too many, {(wanted - got).total()} missing; e.g. {list((got - wanted))[:2]} for {list((wanted - got))[:2]}; columns {order}"
