"""Runs a query and its oracle SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def canonical(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(canonical(x) for x in v)
    return v


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from '{src}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def difference(df, sql: str, sf_dir: str) -> str:
    """'' when the query's rows equal the oracle's, else what differs."""
    cols, rows = duck_rows(sql, sf_dir)
    if cols != df.columns:
        return f"columns {df.columns} against {cols}"
    want = Counter(tuple(map(canonical, r)) for r in rows)
    got = Counter(tuple(canonical(v) for v in r) for r in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; extra {list((got - want))[:3]}; missing {list((want - got))[:3]}"
