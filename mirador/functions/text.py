"""Text predicates used to tell sources apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mentions(text: str | Column, needle: str, null_ok: bool = False) -> Column:
    """Case-blind substring test; a missing text counts as a match when ``null_ok``."""
    return F.coalesce(F.lower(_col(text)).contains(needle.lower()), F.lit(null_ok))


def never_mentions(text: str | Column, needle: str) -> Column:
    """True only for a known text without the needle."""
    return F.coalesce(~F.lower(_col(text)).contains(needle.lower()), F.lit(False))
