"""Column-level number handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(text: str | Column, sentinels: tuple[str, ...] = ()) -> Column:
    """Number held as text; sentinels and text that is no number become null."""
    text = _col(text)
    number = text.try_cast("double")
    return F.when(~text.isin(*sentinels), number) if sentinels else number


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(_col(num), _col(den))


def to_fraction(value: str | Column) -> Column:
    """Percent or fraction to fraction: above 100 is null, 20..100 is percent, 1..20 is null."""
    value = _col(value)
    return (
        F.when(value > 100, None)
        .when(value >= 20, value / 100)
        .when(value > 1, None)
        .otherwise(value)
        .cast("double")
    )


def uniform(*parts: str | Column, seed: int = 42, draw: int = 0) -> Column:
    """Number in [0, 1) that depends on the seed and the row's own columns only.

    Built from eight hexadecimal digits of an md5 digest; ``draw`` 0..3 picks which eight,
    so one digest gives four numbers.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))
    return hex_uniform(digest, draw)


def hex_uniform(digest: Column, draw: int = 0) -> Column:
    digits = F.substring(digest, 8 * draw + 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
