"""Feature screening, model-based importance and recursive elimination."""

from __future__ import annotations

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.storagelevel import StorageLevel

from mirador.prep.split import stratified_holdout
from mirador.roles import Roles


def smd(x: Column, t: Column) -> Column:
    """Standardised mean difference between the arms."""
    one, zero = F.when(t == 1, x), F.when(t == 0, x)
    spread = F.sqrt((F.var_samp(one) + F.var_samp(zero)) / 2)
    return F.try_divide(F.avg(one) - F.avg(zero), spread)


def screen(df: DataFrame, roles: Roles) -> DataFrame:
    """|correlation with the outcome| and standardised mean difference per covariate.

    All covariates are aggregated in one pass, then the single row is turned into rows.
    """
    t, y = F.col(roles.t), F.col(roles.y).cast("double")
    measures = []
    for c in roles.x:
        x = F.col(c).cast("double")
        measures.append(F.struct(
            F.lit(c).alias("feature"), F.abs(F.corr(x, y)).alias("abs_corr"), smd(x, t).alias("smd")
        ))
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def rank_features(scores: DataFrame, k: int, importance: str = "importance") -> DataFrame:
    """Average rank, highest importance first, and the top k. One row per feature."""
    order = Window.orderBy(F.desc(importance))
    ties = Window.partitionBy(importance)
    ranking = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return scores.withColumn("ranking", ranking).orderBy("ranking", "feature").limit(k)


def _vectors(df: DataFrame, roles: Roles, x: list[str]) -> DataFrame:
    rows = df.select(
        F.col(roles.id), F.col(roles.y).cast("double").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in x],
    )
    return VectorAssembler(inputCols=list(x), outputCol="features").transform(rows)


def lasso(rows: int, strength: float, iterations: int) -> LogisticRegression:
    """L1-penalised logistic model; ``strength`` divides the penalty of the summed loss."""
    return LogisticRegression(
        elasticNetParam=1.0, regParam=1.0 / (strength * max(rows, 1)), maxIter=iterations
    )


# Settings of the four rankers (fixed values: strength 2; 200 trees of depth 3 with leaves of
# 6 % at least; 20 of depth 2 with 10 %; 100 boosting rounds). Extremely randomised trees
# become a wider forest.
def rankers(seed: int, rows: int) -> dict:
    return {
        "logistic_l1": lasso(rows, 2, 100),
        "wide_forest": RandomForestClassifier(
            numTrees=200, maxDepth=3, minWeightFractionPerNode=0.06, featureSubsetStrategy="sqrt", seed=seed
        ),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=2, minWeightFractionPerNode=0.1, seed=seed),
        "boosted": GBTClassifier(maxDepth=3, maxIter=100, stepSize=0.1, seed=seed),
    }


def importance(
    df: DataFrame, roles: Roles, models: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """Importance and average rank of each covariate under each model, fitted on ``df``.

    Pass training rows only. As many result rows as models × covariates.
    """
    x = list(roles.x)
    data = _vectors(df, roles, x).select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        for name, model in rankers(seed, data.count()).items():
            if models is not None and name not in models:
                continue
            fitted = model.fit(data)
            weights = fitted.coefficients if name == "logistic_l1" else fitted.featureImportances
            rows += [(name, c, abs(float(w))) for c, w in zip(x, weights.toArray())]
    finally:
        data.unpersist()
    table = df.sparkSession.createDataFrame(rows, "model string, feature string, importance double")
    order = Window.partitionBy("model").orderBy(F.desc("importance"))
    ties = Window.partitionBy("model", "importance")
    ranking = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return table.withColumn("ranking", ranking)


def eliminate(df: DataFrame, roles: Roles, min_k: int = 1, seed: int = 42) -> DataFrame:
    """Recursive elimination with an L1-penalised logistic model and one stratified 80/20 hold-out.

    One row per covariate: the step at which it left (0 = kept), the AUC of the set it was
    last part of, and its rank — kept covariates first, then latest eliminated first.
    """
    x = list(roles.x)
    held = stratified_holdout(df, roles.id, roles.y, 0.2, seed)
    data = df.select(roles.id, roles.y, *x, held.alias("_held")).persist(StorageLevel.MEMORY_AND_DISK)
    judge = BinaryClassificationEvaluator(metricName="areaUnderROC")
    path = []
    try:
        while True:
            train = _vectors(data.filter(~F.col("_held")), roles, x)
            model = lasso(train.count(), 1, 150).fit(train)
            auc = judge.evaluate(model.transform(_vectors(data.filter("_held"), roles, x)))
            weakest = min(zip(x, model.coefficients.toArray()), key=lambda p: abs(p[1]))[0]
            path.append((list(x), auc, weakest))
            if len(x) <= max(min_k, 1):
                break
            x = [c for c in x if c != weakest]
    finally:
        data.unpersist()
    best = max(range(len(path)), key=lambda i: (path[i][1], i))
    kept, best_auc, _ = path[best]
    rows = [(c, 0, float(best_auc), i + 1) for i, c in enumerate(kept)]
    for step in range(best, 0, -1):
        _, auc, dropped = path[step - 1]
        rows.append((dropped, step, float(auc), len(rows) + 1))
    return df.sparkSession.createDataFrame(rows, "feature string, left_at int, auc double, rank int")
