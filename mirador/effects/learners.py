"""S-, T- and X-learners over Spark ML base models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from mirador.functions.numeric import uniform
from mirador.prep.scaling import missing_flags
from mirador.roles import Roles

LEARNERS = ("s", "t", "x")
BASES = ("lr", "gbt", "mlp")

# Base-model settings; any of them can be overridden by keyword.
LR = {"regParam": 0.0, "maxIter": 100}
GBT = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
MLP = {"hidden": 100, "maxIter": 300}


def classifier(base: str, features: str, label: str, width: int, classes: int, seed: int, **params):
    """Base model by name."""
    common = {"featuresCol": features, "labelCol": label}
    if base == "lr":
        return LogisticRegression(**common, **{**LR, **params})
    if base == "gbt":
        return GBTClassifier(**common, seed=seed, **{**GBT, **params})
    if base == "mlp":
        settings = {**MLP, **params}
        layers = [width, settings.pop("hidden"), classes]
        return MultilayerPerceptronClassifier(**common, layers=layers, seed=seed, **settings)
    raise ValueError(f"unknown base learner: {base}")


def regressor(base: str, features: str, label: str, seed: int, **params):
    common = {"featuresCol": features, "labelCol": label}
    if base == "lr":
        return LinearRegression(**common, **{**LR, **params})
    if base == "gbt":
        return GBTRegressor(**common, seed=seed, **{**GBT, **params})
    raise ValueError(f"no regressor for base learner: {base}")


def assembled(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def probability(model: Model, df: DataFrame, name: str) -> DataFrame:
    """Add P(label = 1) and drop the model's own columns."""
    scored = model.transform(df)
    p = vector_to_array(F.col(model.getProbabilityCol()))[1]
    return scored.withColumn(name, p).select(*df.columns, name)


def prediction(model: Model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, F.col(model.getPredictionCol())).select(*df.columns, name)


def expected_class(model: Model, df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Add the mean of the class values under the predicted probabilities."""
    p = vector_to_array(F.col(model.getProbabilityCol()))
    mean = sum((p[i] * F.lit(v) for i, v in enumerate(values)), F.lit(0.0))
    return model.transform(df).withColumn(name, mean).select(*df.columns, name)


@dataclass
class EffectModel:
    """Fitted learner. ``score`` adds y0, y1 and ite to any table with the covariates."""

    learner: str
    base: str
    roles: Roles
    flags: tuple[str, ...]
    models: dict[str, Model] = field(default_factory=dict)

    def _inputs(self, df: DataFrame, with_t: bool = False) -> DataFrame:
        cols = [*self.roles.x, *self.flags] + ([self.roles.t] if with_t else [])
        return assembled(df, cols, "_features")

    def score(self, df: DataFrame) -> DataFrame:
        keep, t = list(df.columns), self.roles.t
        if self.learner == "s":
            out = df.withColumn("_given", F.col(t))
            for value in (1, 0):
                arm = self._inputs(out.withColumn(t, F.lit(value)), with_t=True)
                out = probability(self.models["m"], arm, f"y{value}").drop("_features")
            out = out.withColumn(t, F.col("_given"))
            return out.withColumn("ite", F.col("y1") - F.col("y0")).select(*keep, "y0", "y1", "ite")
        out = self._inputs(df)
        out = probability(self.models["m1"], out, "y1")
        out = probability(self.models["m0"], out, "y0")
        if self.learner == "x":
            out = probability(self.models["g"], out, "_g")
            for arm in (0, 1):
                model = self.models[f"tau{arm}"]
                out = (
                    expected_class(model, out, f"_tau{arm}", [-1.0, 0.0, 1.0])
                    if self.base == "mlp" else prediction(model, out, f"_tau{arm}")
                )
            ite = F.col("_g") * F.col("_tau0") + (1 - F.col("_g")) * F.col("_tau1")
        else:
            ite = F.col("y1") - F.col("y0")
        return out.withColumn("ite", ite).select(*keep, "y0", "y1", "ite")


def fit_effect(
    df: DataFrame, roles: Roles, learner: str, base: str, seed: int = 42,
    flags: tuple[str, ...] = (), weight: str | None = None, **params,
) -> EffectModel:
    """Fit on ``df`` (training rows, scaled and imputed), rows counting by ``weight`` if given.

    ``flags`` names missing-value indicator columns that join the covariates; boosted trees
    need them, as imputed values alone hide what was missing.
    """
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner: {learner}")
    fitted = EffectModel(learner, base, roles, tuple(flags))
    t, y = roles.t, roles.y
    cols = [*roles.x, *flags] + ([t] if learner == "s" else [])
    data = assembled(
        df.withColumns({t: F.col(t).cast("double"), y: F.col(y).cast("double")}), cols, "_features"
    ).select(roles.id, t, y, "_features", *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)

    def make(label: str, classes: int = 2):
        weighted = {"weightCol": weight} if weight else {}
        return classifier(base, "_features", label, len(cols), classes, seed, **weighted, **params)

    try:
        if learner == "s":
            fitted.models["m"] = make(y).fit(data)
            return fitted
        treated, control = data.filter(F.col(t) == 1), data.filter(F.col(t) == 0)
        m1, m0 = make(y).fit(treated), make(y).fit(control)
        fitted.models.update(m1=m1, m0=m0)
        if learner == "x":
            fitted.models["g"] = propensity(data, t, "_features")
            fitted.models.update(_second_stage(base, treated, control, m1, m0, roles, seed, make, params))
        return fitted
    finally:
        data.unpersist()


def _second_stage(base, treated, control, m1, m0, roles, seed, make, params) -> dict[str, Model]:
    """Models of the imputed effects: y − m0(x) on the treated, m1(x) − y on the controls.

    The perceptron has no regression form: the unseen outcome is drawn as 0 or 1 with its
    predicted probability, from the row's id, and three classes −1, 0, 1 are learned. Their
    expected value is the effect.
    """
    y = F.col(roles.y)
    if base == "mlp":
        drawn = (uniform(roles.id, seed=seed) < F.col("_m")).cast("double")
        d1 = probability(m0, treated, "_m").withColumn("_d", y - drawn + 1)
        d0 = probability(m1, control, "_m").withColumn("_d", drawn - y + 1)
        return {"tau1": make("_d", 3).fit(d1), "tau0": make("_d", 3).fit(d0)}
    second = regressor(base, "_features", "_d", seed, **params)
    d1 = probability(m0, treated, "_m").withColumn("_d", y - F.col("_m"))
    d0 = probability(m1, control, "_m").withColumn("_d", F.col("_m") - y)
    return {"tau1": second.fit(d1), "tau0": second.fit(d0)}


def propensity(df: DataFrame, t: str, features: str) -> Model:
    """Unpenalised logistic model of the treatment."""
    return LogisticRegression(featuresCol=features, labelCol=t, **LR).fit(df)


def propensity_score(train: DataFrame, df: DataFrame, roles: Roles, name: str = "propensity") -> DataFrame:
    """Fit on ``train``, score ``df``."""
    model = propensity(
        assembled(train.withColumn(roles.t, F.col(roles.t).cast("double")), list(roles.x), "_features"),
        roles.t, "_features",
    )
    return probability(model, assembled(df, list(roles.x), "_features"), name).drop("_features")


def with_flags(df: DataFrame, x: list[str]) -> tuple[DataFrame, tuple[str, ...]]:
    """Indicator columns for the covariates, to take before imputing."""
    return missing_flags(df, x), tuple(f"{c}_missing" for c in x)
