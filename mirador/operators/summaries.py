"""Aggregates per unit. All are mergeable, so a hot unit is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mirador.functions.timing import whole_units
from mirador.operators.lookups import attach
from mirador.operators.ordered import ROWS_PER_BUCKET, order_statistics


def presence(df: DataFrame, on: list[str], value: str, sep: str = "; ") -> DataFrame:
    """Existence flag and the distinct values as text, in alphabetical order.

    For values of which a key has few; ``distinct_texts`` bounds them.
    """
    distinct = df.select(*on, value).distinct()
    return distinct.groupBy(*on).agg(
        (F.count(F.lit(1)) > 0).alias("present"),
        F.array_join(F.array_sort(F.collect_set(value)), sep).alias("modes"),
    )


def distinct_texts(df: DataFrame, on: list[str], value: str, most: int = 100, sep: str = "; ") -> DataFrame:
    """The first ``most`` distinct values per key as one text, and how many more there are.

    A key's values are ranked under the limit, so each partition passes on ``most`` of them at most
    and no task or row holds more, whatever a key has. Null values are left out; null keys are one
    key. ``rest`` is 0 where the text is complete.
    """
    pairs = df.filter(F.col(value).isNotNull()).select(*on, value).distinct()
    place = F.row_number().over(Window.partitionBy(*on).orderBy(value))
    first = pairs.withColumn("_place", place).filter(F.col("_place") <= most)
    texts = first.groupBy(*on).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias("texts"))
    counts = pairs.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
    joined = texts.alias("l").join(counts.alias("r"), same)
    return joined.select(*[F.col(f"l.{k}") for k in on], "texts", F.greatest(F.col("_n") - most, F.lit(0)).alias("rest"))


def item_stats(
    df: DataFrame, on: list[str], value: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Exact median, max and min per key, skipping nulls and NaN; null keys form a group."""
    found = order_statistics(df, on, value, {"median": 0.5}, rows_per_bucket)
    kind = df.schema[value].dataType
    return found.select(
        *on, "median", F.col("max").cast(kind).alias("max"), F.col("min").cast(kind).alias("min")
    )


def worst_ratio(df: DataFrame, on: list[str], num: str, den: str, name: str = "worst") -> DataFrame:
    """Lowest ratio per key; a zero divisor gives no ratio."""
    return df.groupBy(*on).agg(F.min(F.try_divide(F.col(num), F.col(den))).alias(name))


def all_true(df: DataFrame, on: list[str], pred: Column, name: str = "flag") -> DataFrame:
    """1 when the condition holds on every row of the key; rows with a null key form a group."""
    held = F.coalesce(pred, F.lit(False))
    return df.groupBy(*on).agg(F.bool_and(held).cast("int").alias(name))


def peak_within(
    df: DataFrame, on: str, start: str, stop: str, value: str, hours: int, name: str = "peak"
) -> DataFrame:
    """Highest value among rows that end within ``hours`` whole hours of the unit's first start."""
    first = df.groupBy(on).agg(F.min(start).alias("_first"))
    joined = attach(df, first, on)
    return (
        joined.filter(whole_units(stop, "_first", "HOUR") <= hours)
        .groupBy(on).agg(F.max(value).alias(name))
    )


def missingness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of missing values per column, as rows."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return unpivot(shares, [], cols, "feature", "missing")


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot(ids, cols, name, value)


def by_arm(df: DataFrame, t: str, aggregates: list[Column]) -> DataFrame:
    """Both arms in one pass."""
    return df.groupBy(t).agg(*aggregates)
