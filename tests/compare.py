"""Order-insensitive comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from isolark.plans.bindings import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, (int,)):
        return f"n:{float(value):.6g}" if abs(value) > 1e15 else f"n:{value:.6f}"
    if isinstance(value, float) or value.__class__.__name__ == "Decimal":
        value = float(value)
        if math.isnan(value):
            return "nan"
        return f"n:{value + 0.0:.6f}".replace("n:-0.000000", "n:0.000000")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}={canon(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "isoformat"):
        return "t:" + value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canon(row[i]) for i in order) for row in rows)


def check(df, con, sql: str):
    """Return (message or None, number of rows)."""
    got_rows = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    want_columns = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}", len(got_rows)
    got, want = rows_of(df.columns, got_rows), rows_of(want_columns, want_rows)
    if got == want:
        return None, len(got)
    got_set, want_set = set(got), set(want)
    missing = [w for w in want if w not in got_set][:3]
    extra = [g for g in got if g not in want_set][:3]
    return f"rows {len(got)} vs {len(want)}; only sql: {missing}; only spark: {extra}", len(got)
