"""Effects from cell means: stratified, inverse-weighted and doubly robust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mirador.roles import Roles
from mirador.sources.tables import stage


def cell_means(df: DataFrame, roles: Roles, strata: list[str]) -> DataFrame:
    """Per stratum: size, share treated, outcome mean per arm and their difference."""
    t, y = F.col(roles.t), F.col(roles.y).cast("double")
    cells = df.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n"), F.avg(t.cast("double")).alias("propensity"),
        F.avg(F.when(t == 1, y)).alias("m1"), F.avg(F.when(t == 0, y)).alias("m0"),
    )
    return cells.withColumn("ite", F.col("m1") - F.col("m0"))


def with_cells(df: DataFrame, roles: Roles, strata: list[str]) -> DataFrame:
    """Every row with its stratum's means; rows without a stratum form one."""
    cells = stage(cell_means(df, roles, strata).drop("n"), "cells")  # its size is then known
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in strata]
    means = [F.col(f"r.{c}") for c in cells.columns if c not in strata]
    return df.alias("l").join(cells.alias("r"), same).select("l.*", *means)


def stratified(df: DataFrame, roles: Roles, strata: list[str]) -> DataFrame:
    """Effect per unit, read off its stratum's cell means."""
    return with_cells(df, roles, strata).select(roles.id, "m1", "m0", "ite")


def clipped(e: Column, margin: float = 0.01) -> Column:
    return F.least(F.greatest(e, F.lit(margin)), F.lit(1 - margin))


def ipw(df: DataFrame, roles: Roles, e: str) -> DataFrame:
    """Average effect by normalised inverse-probability weights."""
    t, y, p = F.col(roles.t), F.col(roles.y).cast("double"), clipped(F.col(e))
    w1, w0 = t / p, (1 - t) / (1 - p)
    return df.agg(
        (F.try_divide(F.sum(w1 * y), F.sum(w1)) - F.try_divide(F.sum(w0 * y), F.sum(w0))).alias("ate")
    )


def aipw(df: DataFrame, roles: Roles, m1: str, m0: str, e: str) -> DataFrame:
    """Doubly robust average effect and its standard error, from predictions already on the rows."""
    t, y, p = F.col(roles.t), F.col(roles.y).cast("double"), clipped(F.col(e))
    m1, m0 = F.col(m1), F.col(m0)
    psi = m1 - m0 + t * (y - m1) / p - (1 - t) * (y - m0) / (1 - p)
    return df.agg(
        F.avg(psi).alias("ate"),
        (F.stddev_samp(psi) / F.sqrt(F.count(psi))).alias("se"),
        F.count(psi).alias("n"),
    )
