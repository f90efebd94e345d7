"""Long to wide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mirador.operators.codes import BROADCAST_CODES, lookup_table


def union_feeds(feeds: dict[bool | str, DataFrame], flag: str = "validated") -> DataFrame:
    """Stack feeds of one schema and say which feed a row came from.

    Filters written after this reach every feed's scan.
    """
    tagged = [df.withColumn(flag, F.lit(value)) for value, df in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def map_items(df: DataFrame, item: str, features: dict[str, list], name: str = "feature") -> DataFrame:
    """Many item codes to one feature name; rows of other items are dropped."""
    rows = [(code, feature) for feature, codes in features.items() for code in codes]
    table = lookup_table(df, rows, [item], f"{name} string")
    return df.join(F.broadcast(table) if len(rows) <= BROADCAST_CODES else table, item)


def widen(stats: DataFrame, on: list[str], feature: str, names: list[str], measures: list[str]) -> DataFrame:
    """Pivot (key, feature, measures...) to one row per key, columns ``measure_feature``."""
    wide = stats.groupBy(*on).pivot(feature, names).agg(*[F.first(m, True).alias(m) for m in measures])
    one = len(measures) == 1
    renames = {(n if one else f"{n}_{m}"): f"{m}_{n}" for n in names for m in measures}
    return wide.withColumnsRenamed(renames)


def pick_wide(
    stats: DataFrame, on: list[str], feature: str, picks: list[tuple[str, str]]
) -> DataFrame:
    """Only the wanted (measure, feature) pairs, as conditional aggregates."""
    return stats.groupBy(*on).agg(*[
        F.max(F.when(F.col(feature) == f, F.col(m))).alias(f"{m}_{f}") for m, f in picks
    ])
