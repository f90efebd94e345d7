"""Rules that repair, null, recode and fill values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """What is kept for one item: values in [lower, upper], or strictly inside when ``open``.

    ``validated`` limits the rule to one feed; ``divide_above`` repairs a lost decimal
    separator instead (value / 10 above the limit).
    """

    item: str
    validated: bool | None = None
    lower: float | None = None
    upper: float | None = None
    open_lower: bool = False
    open_upper: bool = False
    divide_above: float | None = None


def apply_rules(
    df: DataFrame, rules: list[Rule], item: str, value: str, validated: str | None = None
) -> DataFrame:
    """Apply each item's rules in order, as one CASE over (item, feed): no join, no shuffle."""
    start = F.col(value).cast("double")
    out = None
    for name in dict.fromkeys(r.item for r in rules):
        mine = [r for r in rules if r.item == name]
        split = any(r.validated is not None for r in mine)
        for feed in (True, False, None) if split else (None,):
            chain = _repaired(start, [r for r in mine if r.validated in (None, feed)])
            here = F.col(item) == name
            if feed is not None:
                here &= F.col(validated) == F.lit(feed)
            out = F.when(here, chain) if out is None else out.when(here, chain)
    return df.withColumn(value, out.otherwise(start) if out is not None else start)


def _repaired(value: Column, rules: list[Rule]) -> Column:
    wrong = F.lit(False)
    for r in rules:
        if r.divide_above is not None:
            value = F.when(wrong, None).otherwise(value)
            value = F.when(value > r.divide_above, value / 10).otherwise(value)
            wrong = F.lit(False)
        if r.lower is not None:
            wrong = wrong | (value <= r.lower if r.open_lower else value < r.lower)
        if r.upper is not None:
            wrong = wrong | (value >= r.upper if r.open_upper else value > r.upper)
    return F.when(wrong, None).otherwise(value)


def require(
    df: DataFrame, not_null: list[str], allowed: dict[str, list] | None = None
) -> DataFrame:
    """Drop rows with a missing value in the subset or a category that is not allowed."""
    kept = df.dropna(subset=not_null)
    for col, values in (allowed or {}).items():
        kept = kept.filter(F.col(col).isin(*values))
    return kept


def recode(value: str | Column, mapping: dict, default: Column | None = None) -> Column:
    """Dictionary lookup; values outside it become ``default`` (null unless given)."""
    value = F.col(value) if isinstance(value, str) else value
    out = None
    for key, to in mapping.items():
        out = F.when(value == key, to) if out is None else out.when(value == key, to)
    return out.otherwise(default) if default is not None else out


def harmonise(
    df: DataFrame, rename: dict[str, str], keep: list[str], maps: dict[str, Column] | None = None
) -> DataFrame:
    """Compute mapped columns, rename, and keep the common schema in its order."""
    return df.withColumns(maps or {}).withColumnsRenamed(rename).select(*keep)


def fill(df: DataFrame, constants: dict[str, object]) -> DataFrame:
    return df.fillna(constants)


def fill_from(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Fill numeric columns from fitted numbers, such as medians."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
        for c, v in values.items() if v is not None
    })


def convert(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Unit conversion by a constant factor per column."""
    return df.withColumns({c: F.col(c) * F.lit(float(f)) for c, f in factors.items()})


def convert_coded(
    value: str | Column, code: str | Column, factors: dict, digits: int = 1
) -> Column:
    """Convert and round half up the values of some unit codes, keep the others."""
    value = F.col(value) if isinstance(value, str) else value
    code = F.col(code) if isinstance(code, str) else code
    out = value.cast("double")
    for unit, factor in factors.items():
        rounded = F.round((value * F.lit(float(factor))).cast("decimal(38,9)"), digits)
        out = F.when(code == unit, rounded.cast("double")).otherwise(out)
    return out
