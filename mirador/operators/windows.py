"""Time windows around an anchor."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from mirador.functions.timing import between, epoch_micros, micros, to_micros
from mirador.operators.lookups import attach


def anchors(df: DataFrame, id: str, ts: str, where: Column, name: str = "anchor_ts") -> DataFrame:
    """Reference time per unit: the first time at which ``where`` holds."""
    return df.filter(where).groupBy(id).agg(F.min(ts).alias(name))


def in_window(
    df: DataFrame,
    anchor: DataFrame,
    on: str,
    ts: str,
    anchor_ts: str,
    lo: dt.timedelta | None,
    hi: dt.timedelta | None,
    closed: str = "both",
    offset: str = "offset_min",
) -> DataFrame:
    """Rows whose time lies in the window around their unit's anchor, with the offset in minutes.

    The anchor table has one row per unit; see ``attach`` for how a hot unit is spread.
    """
    joined = attach(df, anchor.select(on, anchor_ts), on)
    delta = micros(ts, anchor_ts)
    return joined.filter(between(delta, lo, hi, closed)).withColumn(offset, delta / F.lit(6e7))


def overlaps(start: Column, stop: Column, lo: Column, hi: Column) -> Column:
    """True when [start, stop] and [lo, hi] share a point."""
    return (start <= hi) & (stop >= lo)


def within_horizon(
    event: str | Column,
    anchor: str | Column,
    horizon: dt.timedelta,
    closed: bool = False,
    lower: dt.timedelta | None = None,
) -> Column:
    """1 when the event comes before the horizon ends, else 0; no event is 0.

    An event ahead of the anchor counts as 1 unless ``lower`` says otherwise.
    """
    delta = micros(event, anchor)
    hit = between(delta, lower, horizon, "both" if closed else "left")
    return F.coalesce(hit, F.lit(False)).cast("int")


def day_number(ts: str | Column, origin: str | Column | None = None) -> Column:
    """Whole days since the origin (or since 1970), rounded down, also below zero."""
    delta = epoch_micros(ts) if origin is None else micros(ts, origin)
    return F.floor(delta / F.lit(float(to_micros(dt.timedelta(days=1))))).cast("long")
