"""Run a query on Spark and its SQL text on DuckDB over the same files, and compare."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return dt.datetime(value.year, value.month, value.day)
    return value


def sort_key(row):
    return [(v is None, str(type(v)) if v is None else "", str(v)) for v in row]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([plain(r[i]) for i in order] for r in rows), key=sort_key)


def compare(df, con, sql) -> str | None:
    """None when names and all rows agree, else what differs first."""
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    want_names, want = rows_of([d[0] for d in answer.description], answer.fetchall())
    if names != want_names:
        return f"columns {names} against {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    if not got:
        return "no rows"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(names, a))} against {dict(zip(names, b))}"
    return None
