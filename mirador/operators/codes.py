"""Filters by code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

INLINE_CODES = 200
BROADCAST_CODES = 100_000


def in_codes(df: DataFrame, cols: str | list[str], codes) -> DataFrame:
    """Rows whose column (or column pair, triple, ...) is in the code list.

    ``codes`` is a Python list, or a table with the same column names. A short list of
    single codes is pushed into the scan, other Python lists are broadcast after their
    length is checked, and a code table is semi-joined with no forced strategy.
    """
    cols = [cols] if isinstance(cols, str) else cols
    if isinstance(codes, DataFrame):
        return df.join(codes.select(*cols), cols, "left_semi")
    rows = list(dict.fromkeys(c if isinstance(c, tuple) else (c,) for c in codes))
    if len(cols) == 1 and len(rows) <= INLINE_CODES:
        return df.filter(F.col(cols[0]).isin(*[r[0] for r in rows]))
    table = lookup_table(df, rows, cols)
    return df.join(F.broadcast(table) if len(rows) <= BROADCAST_CODES else table, cols, "left_semi")


def lookup_table(df: DataFrame, rows: list[tuple], cols: list[str], extra: str = "") -> DataFrame:
    """Small table from Python rows; the key columns get the types they have in ``df``."""
    keys = [row[: len(cols)] for row in rows]
    if len(set(keys)) < len(keys):
        raise ValueError(f"a key of {cols} is listed twice")
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in cols)
    return df.sparkSession.createDataFrame(rows, schema + (f", {extra}" if extra else ""))
