"""Side-by-side check of registered queries and their SQL twins in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(canonical(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in cur.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short account of the difference."""
    names, rows = spark_rows(df)
    other_names, other = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(rows) != len(other):
        return f"{len(rows)} rows != {len(other)}; first {rows[:2]} {other[:2]}"
    bad = [(a, b) for a, b in zip(rows, other) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ; {names}: {bad[:3]}" if bad else None
