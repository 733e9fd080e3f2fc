"""Row-set comparison of a query with its SQL counterpart."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


DIGITS = 9


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.{DIGITS}g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        tuple(str(_cell(r[i])) for i in order) for r in rows
    )


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    rel = con.execute(sql)
    right_names = [d[0] for d in rel.description]
    right = rel.fetchall()
    if sorted(df.columns) != sorted(right_names):
        return f"columns {sorted(df.columns)} != {sorted(right_names)}"
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    right = rows_of(right_names, right)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None
