"""Compare a query with its SQL in DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, Decimal):
        return float(f"{float(x):.10g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return tuple((k, plain(v)) for k, v in x.asDict().items())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, bool) or not isinstance(x, int):
        return x
    return float(x) if abs(x) < 2**53 else x


def by_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def by_duckdb(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    (a, mine), (b, theirs) = by_spark(df), by_duckdb(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only in SQL {list((theirs - mine).items())[:3]}"
    return ""
