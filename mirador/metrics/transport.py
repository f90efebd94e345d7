"""Optimal transport between the arms in all covariates together, over codebooks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from mirador.sources.tables import stage

COST_SCHEMA = (
    "w2_squared double, lower double, upper double, solver_gap double, n1 bigint, n0 bigint, cells1 int, cells0 int"
)


def soft_min(values: np.ndarray, axis: int) -> np.ndarray:
    """Minus the logarithm of the sum of exp(-values)."""
    least = values.min(axis=axis, keepdims=True)
    return np.squeeze(least, axis) - np.log(np.exp(least - values).sum(axis=axis))


def scaled_plan(
    cost: np.ndarray, a: np.ndarray, b: np.ndarray, sharpness: float = 1e-3, rounds: int = 200, tolerance: float = 1e-6
) -> tuple[float, float]:
    """Upper and lower bound of the least transport cost between the weights ``a`` and ``b``.

    Potentials are found in the log domain, with a smoothing that halves down to ``sharpness`` of the
    mean cost. The upper bound is the cost of a plan whose margins are exactly ``a`` and ``b``, the
    lower one the value of potentials that no pair of cells exceeds.
    """
    f, g = np.zeros(len(a)), np.zeros(len(b))
    mean = float(a @ cost @ b)
    if mean == 0:
        return 0.0, 0.0
    log_a, log_b = np.log(a), np.log(b)
    smoothing, last = float(cost.max()), sharpness * mean
    while True:
        smoothing = max(smoothing / 2, last)
        for _ in range(rounds):
            f = smoothing * soft_min((cost - g) / smoothing - log_b, 1)
            g = smoothing * soft_min((cost - f[:, None]) / smoothing - log_a[:, None], 0)
            plan = np.exp((f[:, None] + g - cost) / smoothing + log_a[:, None] + log_b)
            if np.abs(plan.sum(axis=1) - a).sum() < tolerance:
                break
        if smoothing == last:
            break
    plan *= np.minimum(1, a / plan.sum(axis=1))[:, None]
    plan *= np.minimum(1, b / plan.sum(axis=0))
    left_a, left_b = a - plan.sum(axis=1), b - plan.sum(axis=0)
    if left_a.sum() > 0:
        plan += np.outer(left_a, left_b) / left_a.sum()
    g = (cost - f[:, None]).min(axis=0)
    f = (cost - g).min(axis=1)
    return float((plan * cost).sum()), float(max(0.0, f @ a + g @ b))


def codebook(rows: DataFrame, n: int, dim: int, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Means and weights of an arm's cells, and the mean squared distance of rows from their cell's mean.

    An arm of no more rows than ``cells`` is its own codebook.
    """
    if n <= cells:
        points = np.array([r["_v"] for r in rows.select("_v").collect()], dtype=np.float64).reshape(n, dim)
        return points, np.full(n, 1 / n), 0.0
    vectors = rows.select("_v", array_to_vector("_v").alias("_x"))
    model = KMeans(k=max(2, cells), seed=seed, featuresCol="_x", predictionCol="_cell").fit(vectors)
    item = [F.col("_v")[i] for i in range(dim)]
    found = (
        model.transform(vectors)
        .groupBy("_cell")
        .agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.avg(x) for x in item]).alias("mean"),
            sum((F.var_pop(x) for x in item), F.lit(0.0)).alias("spread"),
        )
        .orderBy("_cell")
        .collect()
    )
    weights = np.array([r["n"] for r in found], dtype=np.float64) / n
    return np.array([r["mean"] for r in found]), weights, float(weights @ [r["spread"] for r in found])


def joint_transport(
    df: DataFrame, vector: str, dim: int, t: str, cells: int = 256, seed: int = 42, sharpness: float = 1e-3
) -> DataFrame:
    """Squared 2-Wasserstein distance of the arms over a column of vectors, with its bounds, as one row.

    Each arm becomes at most ``cells`` cells with their means and counts, found by k-means over all its
    rows; the plan between the cells is solved in the driver, where the work does not grow with the
    rows. w2_squared is the cost of a plan between cells. The distance of the rows differs from that of
    the cells by no more than the root mean squares of the distances between rows and cells, so it
    lies between ``lower`` and ``upper``; ``solver_gap`` is how far the plan's cost may lie above the
    least. Rows without an arm or a vector, of another length or with missing or infinite components
    take no part; repeated rows count each. Without rows in an arm the costs are null.
    """
    known = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vector).cast("array<double>").alias("_v"), F.col(t).cast("int").alias("_t"))
    rows = stage(rows.filter((F.size("_v") == dim) & known & F.col("_t").isin(0, 1)), "arms")
    sizes = {r["_t"]: r["n"] for r in rows.groupBy("_t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        out = (None, None, None, None, n1, n0, 0, 0)
    else:
        (x, a, far1), (y, b, far0) = (
            codebook(rows.filter(F.col("_t") == side), sizes[side], dim, cells, seed) for side in (1, 0)
        )
        cost = ((x[:, None] - y[None]) ** 2).sum(axis=2)
        most, least = scaled_plan(cost, a, b, sharpness)
        off = far1**0.5 + far0**0.5
        out = (most, max(0.0, least**0.5 - off) ** 2, (most**0.5 + off) ** 2, most - least, n1, n0, len(a), len(b))
    return df.sparkSession.createDataFrame([out], COST_SCHEMA)
