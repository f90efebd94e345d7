"""Running totals, ranks and quantiles over sorted rows, without one task per group.

A window over a hot group sorts the whole group in one task. Here sorted rows are cut into
buckets of bounded size by value, each bucket is scanned on its own, and a small table with
one row per group and bucket carries the state from bucket to bucket. The answers are those
of the plain window.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from mirador.sources.tables import stage

ROWS_PER_BUCKET = 1_000_000
# Groups named in a broadcast; more of them are joined by a shuffle.
BROADCAST_GROUPS = 20_000
SAMPLED_PER_BUCKET = 500


@dataclass(frozen=True)
class Running:
    """One running column: ``how`` is sum, min or max.

    ``back`` scans from the high end. ``before`` leaves the row itself out. The nearest row
    that has some property is the max (or, going back, the min) of the order value of the
    rows that have it.
    """

    name: str
    how: str
    value: str
    back: bool = False
    before: bool = False


def cut_points(df: DataFrame, value: str, parts: int, fraction: float = 1.0) -> list[float]:
    """``parts - 1`` quantiles of a numeric column, held on the driver; a long tie repeats.

    They only balance the buckets, so a sample of the rows will do.
    """
    rows = df.select(F.col(value).cast("double").alias("v"))
    rows = rows.sample(fraction, 42) if fraction < 1 else rows
    probs = [i / parts for i in range(1, parts)]
    return sorted(c + 0.0 for c in rows.approxQuantile("v", probs, 0.25 / parts))


def running(
    df: DataFrame,
    by: list[str],
    order: str,
    columns: list[Running],
    tie: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add running columns over ``order`` (then ``tie``) within ``by``.

    ``order`` and ``tie`` are numeric and not null, and one row holds each
    (by, order, tie); pre-aggregate to get there. Groups up to ``rows_per_bucket`` rows are
    plain windows, larger ones are cut into buckets.
    """
    rows = stage(df, "ordered")
    total = rows.count()
    if total <= rows_per_bucket:
        return _scan(rows, by, order, tie, columns)
    if not by:
        return _bucketed(rows, by, order, tie, columns, total, rows_per_bucket)
    # At most total / rows_per_bucket groups are that large.
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(
        F.col("_rows") > rows_per_bucket
    )
    large = stage(large, "large")
    held = large.agg(F.sum("_rows")).first()[0]
    if not held:
        return _scan(rows, by, order, tie, columns)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    keys = F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large
    split = {
        kind: rows.alias("l").join(keys.alias("r"), same, kind) for kind in ("left_anti", "left_semi")
    }
    small = _scan(split["left_anti"], by, order, tie, columns)
    return small.unionByName(
        _bucketed(split["left_semi"], by, order, tie, columns, held, rows_per_bucket)
    )


def _bucketed(rows, by, order, tie, columns, total: int, rows_per_bucket: int) -> DataFrame:
    parts = math.ceil(total / rows_per_bucket)
    fraction = SAMPLED_PER_BUCKET / rows_per_bucket
    cuts = cut_points(rows, order, parts, fraction)
    rows = _bucket(rows, order, cuts, "_bucket")
    cells = ["_bucket"]
    longest = max(Counter(cuts).values(), default=1)
    if tie is not None and longest > 1:
        # A value that is itself a cut point has its own bucket, which may be one long
        # tie: that bucket alone is cut again by the tie column.
        rows = _bucket(rows, tie, cut_points(rows, tie, longest + 1, fraction), "_tied")
        rows = rows.withColumn("_tied", F.when(F.col("_bucket") % 2 == 1, F.col("_tied")).otherwise(0))
        cells.append("_tied")
    carried = _carry(rows, by, cells, columns)
    keys = by + cells
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = rows.alias("l").join(carried.alias("r"), same).select(
        "l.*", *[F.col(f"r._carry_{c.name}") for c in columns]
    )
    scanned = _scan(joined, keys, order, tie, columns)
    for c in columns:
        scanned = scanned.withColumn(c.name, _combine(c, F.col(c.name), F.col(f"_carry_{c.name}")))
    return scanned.drop(*cells, *[f"_carry_{c.name}" for c in columns])


def _bucket(rows: DataFrame, value: str, cuts: list[float], name: str) -> DataFrame:
    """Odd bucket numbers hold exactly one cut value, even ones the values between two cuts."""
    splits = [-math.inf]
    for cut in cuts:
        if cut > splits[-1]:
            splits += [cut, math.nextafter(cut, math.inf)]
    splits.append(math.inf)
    number = F.col(value).cast("double")
    rows = rows.withColumn("_split_on", F.when(number == 0, F.lit(0.0)).otherwise(number))  # no -0.0
    rows = Bucketizer(splits=splits, inputCol="_split_on", outputCol=name).transform(rows)
    return rows.withColumn(name, F.col(name).cast("int")).drop("_split_on")


def _sort(order: str, tie: str | None, back: bool) -> list[Column]:
    keys = [order] + ([tie] if tie else [])
    return [F.desc(k) if back else F.asc(k) for k in keys]


def _function(c: Running, value: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max}[c.how](value)


def _scan(rows, by, order, tie, columns) -> DataFrame:
    added = {}
    for c in columns:
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*_sort(order, tie, c.back))
        window = window.rowsBetween(Window.unboundedPreceding, -1 if c.before else 0)
        value = _function(c, F.col(c.value)).over(window)
        added[c.name] = F.coalesce(value, F.lit(0)) if c.how == "sum" else value
    return rows.withColumns(added)


def _carry(rows, by, cells, columns) -> DataFrame:
    """State of every bucket, then the state of all buckets ahead of it in scan direction."""
    totals = [_function(c, F.col(c.value)).alias(f"_total_{c.name}") for c in columns]
    cell_rows = rows.groupBy(*by, *cells).agg(*totals)
    carried = []
    for c in columns:
        sort = [F.desc(k) if c.back else F.asc(k) for k in cells]
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*sort)
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        carried.append(_function(c, F.col(f"_total_{c.name}")).over(window).alias(f"_carry_{c.name}"))
    return cell_rows.select(*by, *cells, *carried)


def _combine(c: Running, inside: Column, carried: Column) -> Column:
    if c.how == "sum":
        return inside + F.coalesce(carried, F.lit(0))
    return (F.least if c.how == "min" else F.greatest)(inside, carried)


def order_statistics(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``, and its
    ``min`` and ``max``.

    Nulls and NaN are skipped, rows with null keys form groups. There is one path for groups of
    any size: distinct values are counted (partly before the shuffle), the counts are ranked
    and the places are picked by rank.
    """
    number = F.col(value).cast("double")
    counted = df.filter(F.col(value).isNotNull() & ~F.isnan(number)).groupBy(*by, number.alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = running(
        counted, by, "_v",
        [Running("_upto", "sum", "_n"), Running("_above", "sum", "_n", back=True, before=True)],
        rows_per_bucket=rows_per_bucket,
    )
    placed = ranked.withColumn("_size", F.col("_upto") + F.col("_above"))

    def at(position: Column) -> Column:
        inside = (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))
        return F.max(F.when(inside, F.col("_v")))

    picks = []
    for name, p in probs.items():
        place = (F.col("_size") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_w_{name}"),
        ]
    found = placed.groupBy(*by).agg(*picks, F.min("_v").alias("min"), F.max("_v").alias("max"))
    return found.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
        "min", "max",
    )


def quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The quantiles of ``order_statistics`` alone."""
    return order_statistics(df, by, value, probs, rows_per_bucket).select(*by, *probs)


def ordered_rank(
    df: DataFrame,
    value: str,
    id: str,
    name: str = "rank",
    by: list[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Row number by (value, id) ascending, ids numeric and unique."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    ranked = running(
        one, by or [], value, [Running(name, "sum", "_one")], tie=id, rows_per_bucket=rows_per_bucket
    )
    return ranked.drop("_one")
