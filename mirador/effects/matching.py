"""Propensity-score matching: nearest control with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mirador.effects.learners import EffectModel, fit_effect, propensity_score
from mirador.operators.lookups import attach
from mirador.operators.ordered import ROWS_PER_BUCKET, Running, running
from mirador.roles import Roles
from mirador.sources.tables import stage


def nearest_match(
    df: DataFrame, roles: Roles, score: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """For each treated unit the control with the nearest score: (id, match_id, distance).

    Of two equally near controls the lower score wins, then the lower id. Rows are reduced to
    distinct scores, and the control below and above each comes from a scan over the score.
    """
    known = stage(
        df.filter(F.col(score).isNotNull()).select(roles.id, roles.t, F.col(score).alias("_s")),
        "scores",
    )
    points = known.groupBy("_s").agg(
        F.max(F.when(F.col(roles.t) == 0, F.col("_s"))).alias("_control"),
        F.max(F.col(roles.t)).alias("_asked"),
    )
    seen = running(
        points, [], "_s",
        [Running("_below", "max", "_control"), Running("_above", "min", "_control", back=True)],
        rows_per_bucket=rows_per_bucket,
    )
    down, up = F.col("_s") - F.col("_below"), F.col("_above") - F.col("_s")
    nearer = F.when(down.isNull() | (up < down), F.col("_above")).otherwise(F.col("_below"))
    nearest = seen.filter("_asked = 1").select("_s", nearer.alias("_match"))
    controls = known.filter(F.col(roles.t) == 0).groupBy(F.col("_s").alias("_match")).agg(
        F.min(roles.id).alias("match_id")
    )
    answers = attach(nearest, controls, "_match", "left")
    treated = known.filter(F.col(roles.t) == 1)
    return treated.join(answers, "_s").select(
        roles.id, "match_id", F.abs(F.col("_match") - F.col("_s")).alias("distance")
    )


def matched_set(df: DataFrame, roles: Roles, pairs: DataFrame) -> DataFrame:
    """The treated and their controls, a control repeated as often as it was chosen."""
    treated = df.filter(F.col(roles.t) == 1)
    chosen = pairs.filter(F.col("match_id").isNotNull()).select(F.col("match_id").alias(roles.id))
    return treated.unionByName(chosen.join(df, roles.id).select(*df.columns))


def matched_weights(df: DataFrame, roles: Roles, pairs: DataFrame, name: str) -> DataFrame:
    """The treated with weight 1 and their controls with how often each was chosen."""
    treated = df.filter(F.col(roles.t) == 1).withColumn(name, F.lit(1.0))
    chosen = pairs.filter(F.col("match_id").isNotNull()).groupBy(F.col("match_id").alias(roles.id)).agg(
        F.count(F.lit(1)).cast("double").alias(name)
    )
    return treated.unionByName(df.join(stage(chosen, "chosen"), roles.id).select(*df.columns, name))


def fit_matched(
    df: DataFrame, roles: Roles, base: str = "lr", seed: int = 42, **params
) -> tuple[EffectModel, DataFrame]:
    """Propensity model, matching, and one outcome model per arm of the matched set.

    A control chosen many times is one weighted row; the perceptron, which takes no weights,
    gets it as often as it was chosen.
    """
    scored = propensity_score(df, df, roles, "_score")
    pairs = stage(nearest_match(scored, roles, "_score"), "pairs")
    if base == "mlp":
        return fit_effect(matched_set(df, roles, pairs), roles, "t", base, seed, **params), pairs
    weighted = matched_weights(df, roles, pairs, "_weight")
    return fit_effect(weighted, roles, "t", base, seed, weight="_weight", **params), pairs


def matched_effect(model: EffectModel, df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Effect per treated unit: its own outcome under treatment minus its match's under control."""
    roles = model.roles
    scored = model.score(df)
    own = scored.filter(F.col(roles.t) == 1).select(roles.id, "y1")
    other = scored.select(F.col(roles.id).alias("match_id"), "y0")
    return (
        pairs.join(own, roles.id).join(other, "match_id")
        .select(roles.id, "match_id", "y0", "y1", (F.col("y1") - F.col("y0")).alias("ite"))
    )
