"""Train/test split that depends on the id only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mirador.functions.numeric import uniform
from mirador.operators.ordered import ordered_rank


def hash_split(
    df: DataFrame, id: str, frac: float = 0.8, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Add ``train`` or ``test`` per row: no sort, no shuffle, same answer on any partitioning."""
    side = F.when(uniform(id, seed=seed) < F.lit(frac), "train").otherwise("test")
    return df.withColumn(name, side)


def exact_split(
    df: DataFrame, id: str, frac: float = 0.8, seed: int = 42, name: str = "split"
) -> DataFrame:
    """As ``hash_split`` with exactly round(frac · n) training rows; ids numeric and unique."""
    n = df.count()
    ids = ordered_rank(df.select(id).withColumn("_u", uniform(id, seed=seed)), "_u", id, "_rank")
    side = F.when(F.col("_rank") <= round(frac * n), "train").otherwise("test")
    return df.join(ids.select(id, side.alias(name)), id)


def external(df: DataFrame, name: str = "split") -> DataFrame:
    """External cohort: every row is a test row."""
    return df.withColumn(name, F.lit("test"))


def stratified_holdout(
    df: DataFrame, id: str, y: str, frac: float = 0.2, seed: int = 42
) -> Column:
    """True for hold-out rows, hashed apart for each class."""
    return uniform(y, id, seed=seed) < F.lit(frac)
