"""Time arithmetic, all of it on whole microseconds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

DAY = dt.timedelta(days=1)
HOUR = dt.timedelta(hours=1)
MINUTE = dt.timedelta(minutes=1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_micros(span: dt.timedelta) -> int:
    return span // dt.timedelta(microseconds=1)


def micros(later: str | Column, earlier: str | Column) -> Column:
    """later − earlier in microseconds; works for timestamps with and without zone."""
    return F.timestamp_diff("MICROSECOND", _col(earlier), _col(later))


def minutes(later: str | Column, earlier: str | Column) -> Column:
    return micros(later, earlier) / F.lit(6e7)


def whole_units(later: str | Column, earlier: str | Column, unit: str = "HOUR") -> Column:
    """Complete units between two times, truncated toward zero."""
    return F.timestamp_diff(unit, _col(earlier), _col(later))


def epoch_micros(ts: str | Column) -> Column:
    epoch = F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _col(ts).cast("timestamp_ntz"))


def from_epoch_millis(ms: str | Column) -> Column:
    return F.timestamp_millis(_col(ms)).cast("timestamp_ntz")


def between(
    delta: Column, lo: dt.timedelta | None, hi: dt.timedelta | None, closed: str = "both"
) -> Column:
    """lo ≤/< delta ≤/< hi on a microsecond column; either bound may be missing."""
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"unknown closed: {closed}")
    keep = delta.isNotNull()
    if lo is not None:
        keep &= delta >= to_micros(lo) if closed in ("both", "left") else delta > to_micros(lo)
    if hi is not None:
        keep &= delta <= to_micros(hi) if closed in ("both", "right") else delta < to_micros(hi)
    return keep
