"""How far apart the covariates of the two arms are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirador.operators.ordered import ROWS_PER_BUCKET, Running, running
from mirador.operators.summaries import unpivot
from mirador.prep.ranking import smd
from mirador.roles import Roles


def balance(df: DataFrame, roles: Roles) -> DataFrame:
    """Mean per arm and standardised mean difference of each covariate, in one pass."""
    t = F.col(roles.t)
    rows = []
    for c in roles.x:
        x = F.col(c).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.avg(F.when(t == 1, x)).alias("mean_treated"),
            F.avg(F.when(t == 0, x)).alias("mean_control"), smd(x, t).alias("smd"),
        ))
    return df.agg(F.array(*rows).alias("m")).select(F.inline("m"))


def wasserstein(
    long: DataFrame, by: list[str], value: str, t: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Optimal-transport cost between the arms per group: |x−y| (w1) and (x−y)² (w2_squared).

    In one dimension the optimal plan pairs equal quantiles. Arm values are counted, turned
    into cumulative shares, and the two step functions are merged share by share.
    """
    known = long.filter(F.col(value).isNotNull())
    counts = known.groupBy(*by, F.col(value).cast("double").alias("v")).agg(
        F.count(F.when(F.col(t) == 1, 1)).alias("n1"), F.count(F.when(F.col(t) == 0, 1)).alias("n0")
    )
    shares = running(
        counts, by, "v",
        [
            Running("c1", "sum", "n1"), Running("c0", "sum", "n0"),
            Running("r1", "sum", "n1", back=True, before=True),
            Running("r0", "sum", "n0", back=True, before=True),
        ],
        rows_per_bucket=rows_per_bucket,
    ).withColumns({"m1": F.col("c1") + F.col("r1"), "m0": F.col("c0") + F.col("r0")})
    steps = shares.select(
        *by, "v",
        F.inline(F.array(
            F.struct(F.lit(1).alias("arm"), F.try_divide("c1", "m1").alias("u"), F.col("n1").alias("n")),
            F.struct(F.lit(0).alias("arm"), F.try_divide("c0", "m0").alias("u"), F.col("n0").alias("n")),
        )),
    ).filter("n > 0")  # an arm without rows has no share here, and w is null
    levels = steps.groupBy(*by, "u").agg(
        F.max(F.when(F.col("arm") == 1, F.col("v"))).alias("q1"),
        F.max(F.when(F.col("arm") == 0, F.col("v"))).alias("q0"),
    )
    merged = running(
        levels, by, "u",
        [
            # Quantiles grow with the share: the next one up is the lowest still ahead.
            Running("x1", "min", "q1", back=True), Running("x0", "min", "q0", back=True),
            Running("from_u", "max", "u", before=True),
        ],
        rows_per_bucket=rows_per_bucket,
    )
    mass = F.col("u") - F.coalesce("from_u", F.lit(0.0))
    gap = F.col("x1") - F.col("x0")
    return merged.groupBy(*by).agg(
        F.sum(mass * F.abs(gap)).alias("w1"), F.sum(mass * gap * gap).alias("w2_squared")
    )


def wasserstein_by_feature(
    df: DataFrame, roles: Roles, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    long = unpivot(df, [roles.t], list(roles.x), "feature", "value")
    return wasserstein(long, ["feature"], "value", roles.t, rows_per_bucket)


def directions(dim: int, n: int, seed: int = 42) -> list[list[float]]:
    """Seeded unit vectors."""
    raw = np.random.default_rng(seed).normal(size=(n, dim))
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).tolist()


def sliced_wasserstein(
    df: DataFrame, roles: Roles, projections: int = 16, seed: int = 42, digits: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Mean one-dimensional cost over random projections of all covariates together."""
    projected = []
    for i, d in enumerate(directions(len(roles.x), projections, seed)):
        dot = sum((F.col(c) * F.lit(w) for c, w in zip(roles.x, d)), F.lit(0.0))
        projected.append((F.round(dot, digits) if digits is not None else dot).alias(f"p{i}"))
    lines = df.select(roles.t, *projected)
    long = unpivot(lines, [roles.t], [f"p{i}" for i in range(projections)], "projection", "value")
    costs = wasserstein(long, ["projection"], "value", roles.t, rows_per_bucket)
    return costs.agg(F.avg("w1").alias("sliced_w1"), F.avg("w2_squared").alias("sliced_w2_squared"))


def frequencies(dim: int, features: int, scale: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Seeded frequencies and phases of cosines whose products stand for a Gaussian kernel of width ``scale``."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(features, dim)) / scale, rng.uniform(0, 2 * np.pi, features)


def mean_discrepancy(
    df: DataFrame, vector: str, dim: int, t: str, features: int = 128, scale: float | None = None,
    seed: int = 42, weight: str | None = None,
) -> DataFrame:
    """Squared kernel mean discrepancy of the arms over a column of vectors, as one row (mmd2, n1, n0).

    The kernel is Gaussian, written as random cosine features, so the cost is one pass: every
    partition returns its sums per arm and feature, and their differences are squared and added.
    ``scale`` is by default the square root of ``dim``. Rows without a vector, of another length or
    with missing components take no part; rows count by ``weight`` if given. Without rows in an arm
    mmd2 is null.
    """
    frequency, phase = frequencies(dim, features, scale or dim ** 0.5, seed)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((2, features)), np.zeros(2)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                arm, times = batch.column("_t").to_numpy(), batch.column("_w").to_numpy()
                shown = np.cos(x @ frequency.T + phase)
                for side in (0, 1):
                    own = np.where(arm == side, times, 0.0)
                    total[side] += own @ shown
                    count[side] += own.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(features)), *map(pa.array, total[::-1]), *[pa.array(np.full(features, n)) for n in count[::-1]]],
            names=["k", "s1", "s0", "n1", "n0"],
        )

    known = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x))
    rows = df.select(
        F.col(vector).cast("array<double>").alias("_v"), F.col(t).cast("int").alias("_t"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
    ).filter((F.size("_v") == dim) & known & F.col("_t").isNotNull() & F.col("_w").isNotNull())
    parts = rows.mapInArrow(sums, "k bigint, s1 double, s0 double, n1 double, n0 double")
    per_feature = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("s1", "s0", "n1", "n0")])
    mean = lambda side: F.col(f"s{side}") / F.nullif(F.col(f"n{side}"), F.lit(0.0))
    gap = mean(1) - mean(0)
    return per_feature.agg(
        (F.sum(gap * gap) * F.lit(2.0 / features)).alias("mmd2"), F.max("n1").alias("n1"), F.max("n0").alias("n0")
    )


def by_phase(phases: dict[str, tuple[DataFrame, str, int]], t: str, **settings) -> DataFrame:
    """The mean discrepancy of several tables (rows, vector column, its length), a row for each by name."""
    found = [
        mean_discrepancy(rows, vector, dim, t, **settings).select(F.lit(name).alias("phase"), "*")
        for name, (rows, vector, dim) in phases.items()
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
