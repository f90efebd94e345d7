"""Quality of predicted probabilities. ``by`` splits any metric by arm, cohort or model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mirador.operators.ordered import ROWS_PER_BUCKET, Running, running
from mirador.roles import Roles


def observed_arm(t: str, y1: str, y0: str) -> Column:
    """Prediction for the treatment that was given."""
    return F.when(F.col(t) == 1, F.col(y1)).otherwise(F.col(y0))


def _by_score(df, y, p, by) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the low end."""
    outcome = F.col(y).cast("long")
    counted = df.groupBy(*by, F.col(p).cast("double").alias("score")).agg(
        F.sum(outcome).alias("pos"), F.sum(1 - outcome).alias("neg")
    )
    return counted.filter(F.col("score").isNotNull())


def auc(
    df: DataFrame, y: str, p: str, by: list[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null where a class is absent."""
    by = list(by)
    ranked = running(
        _by_score(df, y, p, by), by, "score", [Running("below", "sum", "neg", before=True)],
        rows_per_bucket=rows_per_bucket,
    )
    wins = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("auc"))


def roc(
    df: DataFrame, y: str, p: str, by: list[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One row per distinct score: rates when everything at or above it is called positive."""
    by = list(by)
    ranked = running(
        _by_score(df, y, p, by), by, "score",
        [
            Running("tp", "sum", "pos", back=True), Running("fp", "sum", "neg", back=True),
            Running("fn", "sum", "pos", before=True), Running("tn", "sum", "neg", before=True),
        ],
        rows_per_bucket=rows_per_bucket,
    )
    return ranked.select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
    )


def brier(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    gap = F.col(p).cast("double") - F.col(y)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"), F.count(gap).alias("n"))


def log_loss(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Mean cross entropy with logarithms clamped at −100; missing predictions do not count."""
    p, y = F.col(p).cast("double"), F.col(y).cast("double")

    def log(v: Column) -> Column:
        return F.when(v > 0, F.greatest(F.log(v), F.lit(-100.0))).when(v.isNotNull(), F.lit(-100.0))

    loss = -(y * log(p) + (1 - y) * log(1 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def confusion(df: DataFrame, y: str, p: str, by: list[str] = (), cut: float = 0.5) -> DataFrame:
    """All four cells per group, empty ones as 0; positive means p strictly above the cut."""
    called = (F.col(p) > F.lit(cut)).cast("int")
    truth = F.col(y).cast("int")
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    counts = df.groupBy(*by).agg(*[
        F.count(F.when((truth == a) & (called == b), 1)).alias(f"c{a}{b}") for a, b in cells
    ])
    grid = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n"))
        for a, b in cells
    ])
    return counts.select(*by, F.inline(grid))


def calibration(df: DataFrame, y: str, p: str, by: list[str] = (), bins: int = 10) -> DataFrame:
    """Mean prediction and observed share per right-closed bin; empty bins do not appear, and
    neither do rows without a prediction."""
    df = df.filter(F.col(p).isNotNull())
    bin_no = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)).cast("int").alias("bin")
    return df.groupBy(*by, bin_no).agg(
        F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"),
        F.count(F.lit(1)).alias("n"),
    )


def curves(df: DataFrame, y: str, p: str, cohort: str, bins: int = 10) -> DataFrame:
    """ROC and calibration points of several cohorts in one table (curve, x, y)."""
    points = roc(df, y, p, [cohort]).select(
        cohort, F.lit("roc").alias("curve"), F.col("fpr").alias("x"), F.col("tpr").alias("y")
    )
    bins_ = calibration(df, y, p, [cohort], bins).select(
        cohort, F.lit("calibration").alias("curve"),
        F.col("mean_predicted").alias("x"), F.col("observed").alias("y"),
    )
    return points.unionByName(bins_)


def summary(
    scored: dict[str, DataFrame], y: str, p: str, cohort: str, cohorts: list[str]
) -> DataFrame:
    """AUC of every model (rows) in every cohort (columns), two decimals."""
    tables = [
        df.select(F.lit(name).alias("model"), cohort, y, p) for name, df in scored.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), tables)
    areas = auc(stacked, y, p, ["model", cohort])
    return areas.groupBy("model").agg(*[
        F.round(F.max(F.when(F.col(cohort) == c, F.col("auc"))), 2).alias(f"auc_{c}")
        for c in cohorts
    ])


def evaluate(df: DataFrame, roles: Roles, p: str, by: list[str] = ()) -> DataFrame:
    """AUC and Brier score side by side."""
    by = list(by)
    area, loss = auc(df, roles.y, p, by), brier(df, roles.y, p, by)
    if by:
        return area.join(loss, by)
    return area.withColumn("_k", F.lit(0)).join(loss.withColumn("_k", F.lit(0)), "_k").drop("_k")
