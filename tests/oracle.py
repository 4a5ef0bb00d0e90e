"""Compares queries with their SQL on the same tables, as sets of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def canon(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.6g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(names: list[str], data: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> str:
    rel = con.sql(sql)
    want_names, got_names = list(rel.columns), df.columns
    if sorted(want_names) != sorted(got_names):
        return f"columns {sorted(got_names)} against {sorted(want_names)}"
    got, want = rows(got_names, [tuple(r) for r in df.collect()]), rows(want_names, rel.fetchall())
    if got == want:
        return ""
    a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} against {len(want)} rows; columns {sorted(got_names)}; only here {a}; only there {b}"
