"""Min-max scaling and median imputation from a table of fitted parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mirador.operators.ordered import ROWS_PER_BUCKET, order_statistics
from mirador.operators.summaries import unpivot

def fit_params(
    df: DataFrame, x: list[str], where: Column | None = None, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One row per feature: min, max and exact median over the rows picked by ``where``.

    Nulls and NaN are skipped; a feature without a value has null parameters. One pass counts
    the distinct values of every feature, and the statistics come from those counts.
    """
    fitted = (df.filter(where) if where is not None else df).select(
        *[F.col(c).cast("double").alias(c) for c in x]
    )
    long = unpivot(fitted, [], list(x), "feature", "value")
    stats = order_statistics(long, ["feature"], "value", {"median": 0.5}, rows_per_bucket)
    names = df.sparkSession.createDataFrame([(c,) for c in x], "feature string")
    return names.join(stats, "feature", "left").select("feature", "min", "max", "median")


def params_of(params: DataFrame) -> dict[str, dict[str, float | None]]:
    """Parameters as numbers for use in expressions: a row per column of the wide table."""
    rows = params.select("feature", "min", "max", "median").collect()
    return {r["feature"]: {k: r[k] for k in ("min", "max", "median")} for r in rows}


def _scaled(value: Column, p: dict) -> Column:
    if p["min"] is None:
        return F.lit(None).cast("double")
    span = p["max"] - p["min"]
    if span == 0:
        return F.when(value.isNotNull(), F.lit(0.0))
    return (value.cast("double") - F.lit(p["min"])) / F.lit(span)


def scale(df: DataFrame, params: DataFrame | dict) -> DataFrame:
    """(x − min) / (max − min); nulls stay, a constant column gives 0, no range is enforced."""
    params = params if isinstance(params, dict) else params_of(params)
    return df.withColumns({f: _scaled(F.col(f), p) for f, p in params.items()})


def impute_scaled(df: DataFrame, params: DataFrame | dict) -> DataFrame:
    """Fill scaled columns with the scaled median of the fitting rows."""
    params = params if isinstance(params, dict) else params_of(params)
    return df.withColumns({
        f: F.coalesce(F.col(f), _scaled(F.lit(p["median"]).cast("double"), p))
        for f, p in params.items()
    })


def impute(df: DataFrame, params: DataFrame | dict) -> DataFrame:
    """Fill unscaled columns with the median of the fitting rows."""
    params = params if isinstance(params, dict) else params_of(params)
    return df.withColumns({
        f: F.coalesce(F.col(f).cast("double"), F.lit(p["median"])) for f, p in params.items()
    })


def missing_flags(df: DataFrame, x: list[str], suffix: str = "_missing") -> DataFrame:
    """0/1 indicator columns, taken before imputation, for learners that need them."""
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in x})
