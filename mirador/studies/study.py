"""The study chain: split, scale, impute, select, train, evaluate, interpret — and the same
fitted parts on an external cohort, where nothing is fitted again."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from mirador.effects.learners import EffectModel, fit_effect, propensity_score
from mirador.effects.matching import fit_matched, matched_effect, matched_set, nearest_match
from mirador.effects.store import load_effect, save_effect
from mirador.effects.two_head import TwoHead, fit_two_head
from mirador.metrics import distance, interpretation, scores
from mirador.prep import ranking, scaling, split
from mirador.roles import Roles
from mirador.sources.artefacts import load_params, save_params
from mirador.sources.tables import stage, write_csv

# How many ranked features each kind of model uses unless told otherwise.
FEATURES = {"two_head": 11, "other": 13}


@dataclass
class Study:
    """Fitted parts of one study. ``learner`` is s, t, x, psm or two_head."""

    roles: Roles
    learner: str
    base: str
    params: dict[str, dict]
    ranked: list[str]
    model: EffectModel | TwoHead
    pairs: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def fit(
        cls, table: DataFrame, roles: Roles, learner: str = "t", base: str = "lr", seed: int = 42,
        frac: float = 0.8, features: int | None = None, ranked: list[str] | None = None,
        preselect: str = "boosted", preselected: int = 20, **params,
    ) -> tuple["Study", DataFrame]:
        """Fit on the training rows of an analysis table; returns the study and all rows with
        their split. Give ``ranked`` to skip feature selection."""
        rows = stage(split.hash_split(table, roles.id, frac, seed), "analysis")
        is_train = F.col("split") == "train"
        fitted = scaling.params_of(scaling.fit_params(rows, list(roles.x), is_train))
        usable = roles.with_x(c for c in roles.x if fitted[c]["min"] is not None)
        study = cls(usable, learner, base, {c: fitted[c] for c in usable.x}, [], None)
        train = study.prepare(rows).filter(is_train)
        if ranked is None:
            ranked = select_features(train, usable, preselect, seed, preselected)
        study.ranked = list(ranked)
        count = features or FEATURES["two_head" if learner == "two_head" else "other"]
        used = usable.with_x(study.ranked[:count])
        if learner == "two_head":
            study.model = fit_two_head(train, used, seed=seed, **params)
        elif learner == "psm":
            flags = tuple(f"{c}_missing" for c in used.x) if base == "gbt" else ()
            study.model, study.pairs = fit_matched(train, used, base, seed, flags=flags, **params)
        else:
            flags = tuple(f"{c}_missing" for c in used.x) if base == "gbt" else ()
            study.model = fit_effect(train, used, learner, base, seed, flags, **params)
        return study, rows

    def prepare(self, table: DataFrame) -> DataFrame:
        """Missing flags, then scaling and imputation with the fitted parameters."""
        flagged = scaling.missing_flags(table, list(self.roles.x))
        return scaling.impute_scaled(scaling.scale(flagged, self.params), self.params)

    def score(self, table: DataFrame) -> DataFrame:
        """Both potential outcomes, the effect and the observed-arm prediction for every row of
        ``table``, next to its own unscaled columns. A table without a split is all test."""
        if "split" not in table.columns:
            table = split.external(table)
        raw = {c: f"_raw_{c}" for c in self.roles.x}
        kept = table.withColumns({name: F.col(c) for c, name in raw.items()})
        scored = self.model.score(self.prepare(kept)).select(
            *[F.col(raw.get(c, c)).alias(c) for c in table.columns], "y0", "y1", "ite"
        )
        return scored.withColumn("p", scores.observed_arm(self.roles.t, "y1", "y0"))

    def evaluate(self, scored: DataFrame) -> dict[str, DataFrame]:
        """Tables on the test rows: AUC and Brier, confusion, ROC, calibration, loss per arm."""
        test, y, t = scored.filter("split = 'test'"), self.roles.y, self.roles.t
        return {
            "quality": scores.evaluate(test, self.roles, "p"),
            "confusion": scores.confusion(test, y, "p"),
            "log_loss": scores.log_loss(test, y, "p", [t]),
            "roc": scores.roc(test, y, "p"),
            "calibration": scores.calibration(test, y, "p"),
        }

    def interpret(self, scored: DataFrame, resamples: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
        """Tables on all rows: average effect, responder groups, their profile, intervals, curve."""
        x = list(self.roles.x)
        grouped = scaling.impute(scored, self.params).withColumn(
            "grp", interpretation.responder_group("ite")
        )
        return {
            "ate": interpretation.ate(scored, "ite"),
            "groups": grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("ite").alias("mean_ite")),
            "profile": interpretation.describe_by(grouped, "grp", x + ["ite"]),
            "intervals": interpretation.bootstrap(grouped, self.roles.id, x, "grp", resamples, seed),
            "curve": interpretation.ordered_curve(scored, "ite", self.roles.id),
        }

    def match(self, rows: DataFrame) -> DataFrame:
        """Each treated unit's nearest control by propensity, fitted afresh on these rows."""
        used = self.model.roles
        prepared = self.prepare(rows)
        return stage(nearest_match(propensity_score(prepared, prepared, used, "_score"), used, "_score"), "pairs")

    def matched(self, rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """Effect per treated unit against its match, on the fitting cohort or a new one."""
        return matched_effect(self.model, self.prepare(rows), self.match(rows) if pairs is None else pairs)

    def balance(self, rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """Transport cost between the arms per covariate, before matching and, given pairs, after."""
        prepared = self.prepare(rows)
        phases = {"before": prepared}
        if pairs is not None:
            phases["after"] = matched_set(prepared, self.roles, pairs)
        costs = [
            distance.wasserstein_by_feature(df, self.roles).withColumn("phase", F.lit(phase))
            for phase, df in phases.items()
        ]
        return reduce(lambda a, b: a.unionByName(b), costs)

    def report(self, scored: DataFrame, path: str, resamples: int = 1000) -> None:
        """Every table of ``evaluate`` and ``interpret`` as text under ``path``."""
        tables = {**self.evaluate(scored), **self.interpret(scored, resamples)}
        for name, table in tables.items():
            write_csv(table, f"{path}/{name}")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, p["min"], p["max"], p["median"]) for c, p in self.params.items()]
        save_params(
            spark.createDataFrame(rows, "feature string, min double, max double, median double"),
            f"{path}/params",
        )
        order = [(i, c) for i, c in enumerate(self.ranked)]
        spark.createDataFrame(order, "rank int, feature string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/ranked")
        facts = [(self.roles.id, self.roles.t, self.roles.y, list(self.roles.x), self.learner, self.base)]
        spark.createDataFrame(
            facts, "id string, t string, y string, x array<string>, learner string, base string"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/study")
        save_effect(spark, self.model, f"{path}/model")
        if self.pairs is not None:
            self.pairs.write.mode("overwrite").parquet(f"{path}/pairs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Study":
        fact = spark.read.parquet(f"{path}/study").first()
        roles = Roles(fact["id"], fact["t"], fact["y"], tuple(fact["x"]))
        ranked = [r["feature"] for r in spark.read.parquet(f"{path}/ranked").orderBy("rank").collect()]
        params = scaling.params_of(load_params(spark, f"{path}/params"))
        pairs = spark.read.parquet(f"{path}/pairs") if fact["learner"] == "psm" else None
        model = load_effect(spark, f"{path}/model")
        return cls(roles, fact["learner"], fact["base"], params, ranked, model, pairs)


def select_features(
    train: DataFrame, roles: Roles, preselect: str = "boosted", seed: int = 42, preselected: int = 20
) -> list[str]:
    """The most important features of one ranker, in the order recursive elimination leaves them."""
    scored = ranking.importance(train, roles, [preselect], seed)
    top = scored.orderBy("ranking", "feature").limit(preselected).collect()
    order = ranking.eliminate(train, roles.with_x(r["feature"] for r in top), 1, seed)
    return [r["feature"] for r in order.orderBy("rank").collect()]


def compare(
    studies: dict[str, Study], cohorts: dict[str, DataFrame], y: str | None = None
) -> DataFrame:
    """AUC of every fitted or loaded study (rows) in every cohort's test rows (columns)."""
    scored = {}
    for name, study in studies.items():
        tables = [
            study.score(table).filter("split = 'test'").select(
                F.lit(cohort).alias("cohort"), F.col(y or study.roles.y).alias("y"), "p"
            )
            for cohort, table in cohorts.items()
        ]
        scored[name] = reduce(lambda a, b: a.unionByName(b), tables)
    return scores.summary(scored, "y", "p", "cohort", list(cohorts))
