"""Local twin of the oracle comparison: Spark rows against DuckDB rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_norm, v)) + "]"
    if hasattr(v, "tzinfo") and v is not None and hasattr(v, "replace"):
        return str(v.replace(tzinfo=None))
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf_dir).execute(sql)
    cols = [d[0] for d in rel.description]
    theirs = rows_of(cols, rel.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"{name}: columns {sorted(df.columns)} != {sorted(cols)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{name}: rows {len(mine)} vs {len(theirs)}; only spark {sorted(a)[:3]}; only duckdb {sorted(b)[:3]}"
    return None
