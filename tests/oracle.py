"""Runs a registered query beside its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connection(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(d).iterdir()):
        if p.suffix == ".parquet":
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in x.items()))
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def compare(df, sql: str, d: str) -> str:
    """'' if both give the same columns and rows; else what differs."""
    con = connection(d)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = [dict(zip(names, r)) for r in rel.fetchall()]
    got = [r.asDict(recursive=True) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    key = lambda r: tuple(plain(r[c]) for c in sorted(names))
    a, b = Counter(map(key, got)), Counter(map(key, want))
    if a == b:
        return ""
    return f"{len(got)} rows against {len(want)}; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
