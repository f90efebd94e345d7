"""Doses: daily sums, thresholds, unit normalisation, equivalence factors, step tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mirador.operators.codes import BROADCAST_CODES, lookup_table
from mirador.operators.ordered import ROWS_PER_BUCKET, Running, running
from mirador.operators.windows import day_number
from mirador.sources.tables import stage

# Longer step tables are an array, not a chain of conditions.
INLINE_STEPS = 500


def per_day(
    df: DataFrame, on: list[str], ts: str, value: str, origin: str | None = None, dense: bool = False
) -> DataFrame:
    """Sum per key and day. ``dense`` adds the empty days between a key's first and last as 0."""
    daily = df.groupBy(*on, day_number(ts, origin).alias("day")).agg(F.sum(value).alias("total"))
    if not dense:
        return daily
    spans = daily.groupBy(*on).agg(F.min("day").alias("_a"), F.max("day").alias("_z"))
    days = spans.select(*on, F.explode(F.sequence("_a", "_z")).alias("day"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*on, "day"]]
    filled = days.alias("d").join(daily.alias("t"), same, "left")
    return filled.select("d.*", F.coalesce("t.total", F.lit(0.0)).alias("total"))


def threshold_flag(
    daily: DataFrame, on: str, item: str, total: str, thresholds: dict, spine: DataFrame,
    name: str = "treated",
) -> DataFrame:
    """1 for units with some day at or over its item's threshold, else 0."""
    over = F.lit(False)
    for code, limit in thresholds.items():
        over = over | ((F.col(item) == code) & (F.col(total) >= limit))
    ids = daily.filter(over).select(on).distinct().withColumn(name, F.lit(1))
    return spine.select(on).join(ids, on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def step_value(
    group: str | Column, x: str | Column, steps: list[tuple], default: float
) -> Column:
    """Step function by group: rows (group, lo, hi, value) mean lo ≤ x < hi, hi may be None.

    The first row that fits counts. Long tables are searched as an array, which keeps the
    generated code short; a table of rows is looked up with ``join_steps``.
    """
    group = F.col(group) if isinstance(group, str) else group
    x = F.col(x) if isinstance(x, str) else x
    if len(steps) > INLINE_STEPS:
        rows = F.array(*[
            F.struct(
                F.lit(g).alias("g"), F.lit(float(lo)).alias("lo"),
                F.lit(None if hi is None else float(hi)).cast("double").alias("hi"),
                F.lit(float(value)).alias("v"),
            )
            for g, lo, hi, value in steps
        ])
        fits = F.filter(
            rows, lambda s: (s["g"] == group) & (x >= s["lo"]) & (s["hi"].isNull() | (x < s["hi"]))
        )
        return F.coalesce(F.get(fits, 0)["v"], F.lit(float(default)))
    out = None
    for g, lo, hi, value in steps:
        hit = (group == g) & (x >= lo)
        if hi is not None:
            hit &= x < hi
        out = F.when(hit, F.lit(float(value))) if out is None else out.when(hit, F.lit(float(value)))
    return out.otherwise(F.lit(float(default)))


def join_steps(
    df: DataFrame, group: str, x: str, steps: DataFrame, default: float, name: str = "step",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``step_value`` for a table of steps (group, lo, hi, value) that do not overlap.

    A value's step is the last one of its group that starts at or below it, found by a running
    maximum over the distinct values and the starts together, so no pairs are formed.
    """
    steps = steps.toDF("_group", "_lo", "_hi", "_value")
    known = df.filter(F.col(group).isNotNull() & F.col(x).isNotNull())
    points = known.select(F.col(group).alias("_group"), F.col(x).cast("double").alias("_x")).distinct()
    starts = steps.select("_group", F.col("_lo").cast("double").alias("_x"), F.col("_lo").cast("double").alias("_at"))
    merged = points.unionByName(starts, allowMissingColumns=True).groupBy("_group", "_x").agg(
        F.max("_at").alias("_at")
    )
    placed = running(
        merged, ["_group"], "_x", [Running("_start", "max", "_at")], rows_per_bucket=rows_per_bucket
    )
    rows = steps.select(
        F.col("_group").alias("_g"), F.col("_lo").cast("double").alias("_l"), F.col("_hi").alias("_h"), "_value"
    )
    found = placed.join(rows, (F.col("_group") == F.col("_g")) & (F.col("_start") == F.col("_l"))).filter(
        F.col("_h").isNull() | (F.col("_x") < F.col("_h"))
    )
    found = stage(found.select("_group", "_x", "_value"), "steps")
    joined = df.join(found, (F.col(group) == F.col("_group")) & (F.col(x).cast("double") == F.col("_x")), "left")
    return joined.withColumn(name, F.coalesce("_value", F.lit(float(default)))).drop("_group", "_x", "_value")


def normalise(
    df: DataFrame, keys: list[str], factors: list[tuple], dose: str, weight: str | None = None,
    name: str = "dose_norm",
) -> DataFrame:
    """Dose × the factor of its unit key; ``factors`` rows are (*keys, factor, per_weight).

    Rows flagged ``per_weight`` are divided by the weight. Unknown units give null.
    """
    table = lookup_table(df, factors, keys, "_factor double, _per_weight boolean")
    joined = df.join(F.broadcast(table) if len(factors) <= BROADCAST_CODES else table, keys, "left")
    out = F.col(dose) * F.col("_factor")
    if weight is not None:
        out = F.when(F.col("_per_weight"), F.try_divide(out, F.col(weight))).otherwise(out)
    return joined.withColumn(name, out).drop("_factor", "_per_weight")


def equivalent(
    df: DataFrame, on: list[str], substance: str, dose: Column, factors: dict, per: Column,
) -> DataFrame:
    """Sum of dose × equivalence factor per key, and that sum ÷ the longest stay."""
    table = lookup_table(df, [(k, float(v)) for k, v in factors.items()], [substance], "_f double")
    small = len(factors) <= BROADCAST_CODES
    joined = df.join(F.broadcast(table) if small else table, substance, "left")
    summed = joined.groupBy(*on).agg(
        F.sum(dose * F.col("_f")).alias("total"), F.max(per).alias("_per")
    )
    return summed.withColumn("per_unit", F.try_divide("total", "_per")).drop("_per")


def interval_summary(df: DataFrame, on: list[str], duration: str, rate: str) -> DataFrame:
    return df.groupBy(*on).agg(
        F.sum(duration).alias("total_duration"), F.max(rate).alias("max_rate")
    )
