"""Feature preparation, effects, evaluation and interpretation on the sales cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mirador.effects import learners, matching, strata, tuning, two_head
from mirador.metrics import distance, interpretation, scores, transport
from mirador.operators import cleaning
from mirador.operators.summaries import unpivot
from mirador.plans.bindings import SALES, SALES_SQL, SCORE_SQL, sales, scored_sales
from mirador.plans.registry import Tables, query
from mirador.prep import ranking, scaling, split
from mirador.roles import Roles
from mirador.sources.artefacts import load_params, save_params
from mirador.sources.tables import read_positions, stage, write_sorted
from mirador.sources.workspace import scratch

X = list(SALES.x)
UNIFORM_SQL = "CAST(('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
SPLIT_SQL = f"{SALES_SQL}, parted AS (SELECT *, CASE WHEN {UNIFORM_SQL} < 0.8 THEN 'train' ELSE 'test' END AS split FROM sales)"


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def parted(t: Tables) -> DataFrame:
    """The analysis table with its split, written once because every fit reads it again."""
    return stage(split.hash_split(sales(t), "id"), "analysis")


# ---- preparation -------------------------------------------------------------------------


@query("train_test_split", f"WITH {SPLIT_SQL} SELECT id, split FROM parted")
def train_test_split(t: Tables):
    customers = t("customer", "c_custkey").withColumnRenamed("c_custkey", "id")
    return split.hash_split(customers, "id").select("id", "split")


@query("train_test_split_exact", f"""
WITH u AS (SELECT c_custkey AS id, {UNIFORM_SQL.replace("(id ", "(c_custkey ")} AS u FROM customer)
SELECT id, CASE WHEN row_number() OVER (ORDER BY u, id) <= (SELECT round(0.8 * count(*)) FROM u)
  THEN 'train' ELSE 'test' END AS split FROM u""")
def train_test_split_exact(t: Tables):
    customers = t("customer", "c_custkey").withColumnRenamed("c_custkey", "id")
    return split.exact_split(customers, "id").select("id", "split")


def _params_sql(where: str, source: str = "parted") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
        f"median({c})::DOUBLE AS median FROM {source} WHERE {where}"
        for c in X
    )


@query("scale_impute_params", f"""
WITH {SPLIT_SQL}, params AS ({_params_sql("split = 'train'")})
SELECT feature, round(min, 9) AS min, round(max, 9) AS max, round(median, 9) AS median FROM params""")
def scale_impute_params(t: Tables):
    fitted = scaling.fit_params(parted(t), X, F.col("split") == "train")
    return rounded(fitted, ["min", "max", "median"], 9)


def _scaled_sql(c: str, value: str, params: str) -> str:
    lo = f"(SELECT min FROM {params} WHERE feature = '{c}')"
    hi = f"(SELECT max FROM {params} WHERE feature = '{c}')"
    return f"({value} - {lo}) / ({hi} - {lo})"


def _scale_select(params: str, impute: bool) -> str:
    out = []
    for c in X:
        value = f"CAST({c} AS DOUBLE)"
        if impute:
            value = f"coalesce({value}, (SELECT median FROM {params} WHERE feature = '{c}'))"
        out.append(f"round({_scaled_sql(c, value, params)}, 6) AS {c}")
    return ", ".join(out)


@query("minmax_scale", f"""
WITH {SPLIT_SQL}, params AS ({_params_sql("split = 'train'")})
SELECT id, split, {_scale_select("params", False)} FROM parted""")
def minmax_scale(t: Tables):
    table = parted(t)
    fitted = scaling.fit_params(table, X, F.col("split") == "train")
    return rounded(scaling.scale(table.select("id", "split", *X), fitted), X)


@query("scale_impute", f"""
WITH {SPLIT_SQL}, params AS ({_params_sql("split = 'train'")})
SELECT id, split, {_scale_select("params", True)} FROM parted""")
def scale_impute(t: Tables):
    table = parted(t)
    fitted = scaling.params_of(scaling.fit_params(table, X, F.col("split") == "train"))
    done = scaling.impute_scaled(scaling.scale(table.select("id", "split", *X), fitted), fitted)
    return rounded(done, X)


@query("external_scale_impute", f"""
WITH {SPLIT_SQL}, params AS ({_params_sql("split = 'train' AND c_nationkey < 20")})
SELECT id, 'test' AS split, {_scale_select("params", True)} FROM parted WHERE c_nationkey >= 20""")
def external_scale_impute(t: Tables):
    table = parted(t)
    internal = (F.col("split") == "train") & (F.col("c_nationkey") < 20)
    path = scratch(t.spark, "params")
    save_params(scaling.fit_params(table, X, internal), path)
    fitted = scaling.params_of(load_params(t.spark, path))
    outside = split.external(table.filter("c_nationkey >= 20").select("id", *X))
    return rounded(scaling.impute_scaled(scaling.scale(outside, fitted), fitted), X)


@query("median_fill", f"""
WITH {SPLIT_SQL}, params AS ({_params_sql("split = 'train'")})
SELECT id, {", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT round(median, 6) FROM params WHERE feature = '{c}')) AS {c}" for c in X)}
FROM parted""")
def median_fill(t: Tables):
    table = parted(t)
    fitted = scaling.params_of(scaling.fit_params(table, X, F.col("split") == "train"))
    medians = {c: round(p["median"], 6) for c, p in fitted.items()}
    return cleaning.fill_from(table.select("id", *X), medians)


def _smd_sql(c: str) -> str:
    one, zero = f"CASE WHEN t = 1 THEN {c} END", f"CASE WHEN t = 0 THEN {c} END"
    return f"(avg({one}) - avg({zero})) / nullif(sqrt((var_samp({one}) + var_samp({zero})) / 2), 0)"


@query("feature_screen", f"""
WITH {SALES_SQL} {" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, y)), 6) AS abs_corr, round({_smd_sql(c)}, 6) AS smd FROM sales"
    for c in X)}""")
def feature_screen(t: Tables):
    return rounded(ranking.screen(sales(t), SALES), ["abs_corr", "smd"])


@query("feature_rank", f"""
WITH {SALES_SQL}, s AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, y)), 6) AS importance FROM sales" for c in X)}),
r AS (SELECT *, rank() OVER (ORDER BY importance DESC)
        + (count(*) OVER (PARTITION BY importance) - 1) / 2.0::DOUBLE AS ranking FROM s)
SELECT * FROM r ORDER BY ranking, feature LIMIT 3""")
def feature_rank(t: Tables):
    screened = ranking.screen(sales(t), SALES)
    importance = screened.select("feature", F.round("abs_corr", 6).alias("importance"))
    return ranking.rank_features(importance, 3)


def prepared(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Scaled and imputed analysis table: all rows, and the training rows."""
    table = parted(t)
    fitted = scaling.params_of(scaling.fit_params(table, X, F.col("split") == "train"))
    done = scaling.impute_scaled(scaling.scale(table, fitted), fitted)
    return done, done.filter("split = 'train'")


@query("feature_importance")
def feature_importance(t: Tables):
    return ranking.importance(prepared(t)[1], SALES)


@query("recursive_elimination")
def recursive_elimination(t: Tables):
    return ranking.eliminate(prepared(t)[1], SALES)


# ---- effects -----------------------------------------------------------------------------


def _register(learner: str, base: str) -> None:
    @query(f"{learner}_learner_{base}")
    def effect(t: Tables):
        table = parted(t)
        fitted = scaling.params_of(scaling.fit_params(table, X, F.col("split") == "train"))
        flags: tuple[str, ...] = ()
        if base == "gbt":
            table, flags = learners.with_flags(table, X)
        done = scaling.impute_scaled(scaling.scale(table, fitted), fitted)
        train = done.filter("split = 'train'")
        model = learners.fit_effect(train, SALES, learner, base, flags=flags)
        return model.score(done).select("id", "split", "t", "y", "y0", "y1", "ite")


for _learner in learners.LEARNERS:
    for _base in learners.BASES:
        _register(_learner, _base)


@query("propensity_score")
def propensity_score(t: Tables):
    done, train = prepared(t)
    return learners.propensity_score(train, done, SALES).select("id", "t", "propensity")


# An unpenalised logistic fit meets Σ p·x = Σ y·x over its rows, for every covariate and for
# the intercept: the means under the fit have a closed form in the data.
TIGHT = {"tol": 1e-12, "maxIter": 500}


def _moments_sql(outcome: str, by: str, rows: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {by} AS arm, '{c}' AS feature, round(avg({outcome} * {'1' if c == 'intercept' else c}), 3) AS mean "
        f"FROM scaled WHERE {rows} GROUP BY 1" for c in columns
    )


SCALED_SQL = f"""{SPLIT_SQL}, params AS ({_params_sql("split = 'train'")}),
scaled AS (SELECT id, split, t, y, {_scale_select("params", True)} FROM parted)"""


def _moments(fitted: DataFrame, by: str | None, p: str, columns: list[str]) -> DataFrame:
    """Means of prediction times covariate, as rows."""
    value = lambda c: F.lit(1.0) if c == "intercept" else F.round(F.col(c).cast("double"), 6)
    means = [
        F.struct(F.lit(c).alias("feature"), F.round(F.avg(F.col(p) * value(c)), 3).alias("mean")) for c in columns
    ]
    arm = F.col(by) if by else F.lit(-1)
    return fitted.groupBy(arm.alias("arm")).agg(F.array(*means).alias("m")).select("arm", F.inline("m"))


@query("propensity_moments", f"""
WITH {SCALED_SQL} {_moments_sql("t", "-1", "split = 'train'", ["intercept", *X])}""")
def propensity_moments(t: Tables):
    _, train = prepared(t)
    fitted = learners.propensity_score(train, train, SALES)
    return _moments(fitted, None, "propensity", ["intercept", *X])


@query("t_learner_moments", f"""
WITH {SCALED_SQL} {_moments_sql("y", "t", "split = 'train'", ["intercept", *X])}""")
def t_learner_moments(t: Tables):
    _, train = prepared(t)
    model = learners.fit_effect(train, SALES, "t", "lr", **TIGHT)
    fitted = model.score(train).withColumn("p", scores.observed_arm("t", "y1", "y0"))
    return _moments(fitted, "t", "p", ["intercept", *X])


@query("s_learner_moments", f"""
WITH {SCALED_SQL} {_moments_sql("y", "-1", "split = 'train'", ["intercept", "t", *X])}""")
def s_learner_moments(t: Tables):
    _, train = prepared(t)
    model = learners.fit_effect(train, SALES, "s", "lr", **TIGHT)
    fitted = model.score(train).withColumn("p", scores.observed_arm("t", "y1", "y0"))
    return _moments(fitted, None, "p", ["intercept", "t", *X])


@query("psm_effect")
def psm_effect(t: Tables):
    done, train = prepared(t)
    model, _ = matching.fit_matched(train, SALES)
    scored = learners.propensity_score(train, done, SALES)
    pairs = stage(matching.nearest_match(scored, SALES, "propensity"), "pairs")
    return matching.matched_effect(model, done, pairs)


@query("two_head_effect")
def two_head_effect(t: Tables):
    """The network at its own size: width, epochs and rate of the defaults."""
    done, train = prepared(t)
    model = two_head.fit_two_head(train, SALES)
    return model.score(done).select("id", "split", "t", "y", "y0", "y1", "ite")


@query("two_head_effect_short")
def two_head_effect_short(t: Tables):
    """A small network and 40 epochs, each a job over all partitions."""
    done, train = prepared(t)
    model = two_head.fit_two_head(train, SALES, width=16, epochs=40, lr=1e-2, task_cells=0)
    return model.score(done).select("id", "split", "t", "y", "y0", "y1", "ite")


@query("tuning_trials")
def tuning_trials(t: Tables):
    """Ten networks from the network's space; the table has five covariates to choose from."""
    train = prepared(t)[1]
    space = tuning.NETWORK_SPACE | {"features": (3, len(X), "int")}
    params = F.col("params")
    return tuning.search(train, SALES, space, trials=10, learner="two_head").select(
        "trial", params["lr"].alias("lr"), params["epochs"].cast("int").alias("epochs"),
        params["width"].cast("int").alias("width"), params["features"].cast("int").alias("features"), "auc",
    )


@query("tuning_trials_lr")
def tuning_trials_lr(t: Tables):
    """The same search for a T-learner's penalty."""
    train = prepared(t)[1]
    space = {"regParam": (1e-6, 1e-1, "log"), "features": (2, len(X), "int")}
    trials = tuning.search(train, SALES, space, trials=10)
    return trials.select(
        "trial", F.col("params")["regParam"].alias("reg_param"),
        F.col("params")["features"].cast("int").alias("features"), "auc",
    )


STRATA_SQL = """strata AS (
  SELECT *, c_mktsegment || '/' || CASE WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 6500 THEN 'mid'
    ELSE 'high' END AS stratum FROM sales),
cell AS (
  SELECT stratum, count(*) AS n, avg(CAST(t AS DOUBLE)) AS propensity,
    avg(CASE WHEN t = 1 THEN CAST(y AS DOUBLE) END) AS m1,
    avg(CASE WHEN t = 0 THEN CAST(y AS DOUBLE) END) AS m0 FROM strata GROUP BY stratum),
joined AS (
  SELECT s.id, s.t, s.y, c.m1, c.m0, c.m1 - c.m0 AS ite,
    least(greatest(c.propensity, 0.01::DOUBLE), 0.99::DOUBLE) AS e
  FROM strata s JOIN cell c ON c.stratum = s.stratum)"""


def with_stratum(df: DataFrame) -> DataFrame:
    balance = F.when(F.col("c_acctbal") < 3000, "low").when(F.col("c_acctbal") < 6500, "mid").otherwise("high")
    return df.withColumn("stratum", F.concat_ws("/", "c_mktsegment", balance))


@query("stratified_t_learner", f"""
WITH {SALES_SQL}, {STRATA_SQL}
SELECT id, round(m1, 6) AS m1, round(m0, 6) AS m0, round(ite, 6) AS ite FROM joined""")
def stratified_t_learner(t: Tables):
    table = with_stratum(stage(sales(t), "analysis"))
    effects = strata.stratified(table, SALES, ["stratum"])
    return rounded(effects, ["m1", "m0", "ite"])


def _celled(t: Tables) -> DataFrame:
    return strata.with_cells(with_stratum(stage(sales(t), "analysis")), SALES, ["stratum"])


@query("ipw_ate", f"""
WITH {SALES_SQL}, {STRATA_SQL}
SELECT round(sum(t / e * y) / sum(t / e) - sum((1 - t) / (1 - e) * y) / sum((1 - t) / (1 - e)), 6) AS ate
FROM joined""")
def ipw_ate(t: Tables):
    return rounded(strata.ipw(_celled(t), SALES, "propensity"), ["ate"])


@query("aipw_ate", f"""
WITH {SALES_SQL}, {STRATA_SQL}, psi AS (
  SELECT m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) AS psi FROM joined)
SELECT round(avg(psi), 6) AS ate, round(stddev_samp(psi) / sqrt(count(psi)), 6) AS se, count(psi) AS n
FROM psi""")
def aipw_ate(t: Tables):
    return rounded(strata.aipw(_celled(t), SALES, "m1", "m0", "propensity"), ["ate", "se"])


PSM_SQL = """control AS (SELECT propensity AS s, min(id) AS cid FROM scored WHERE t = 0 GROUP BY 1),
near AS (
  SELECT x.id, x.propensity AS s,
    (SELECT max(c.s) FROM control c WHERE c.s <= x.propensity) AS below,
    (SELECT min(c.s) FROM control c WHERE c.s >= x.propensity) AS above
  FROM scored x WHERE x.t = 1),
picked AS (
  SELECT id, s, CASE WHEN below IS NULL OR above - s < s - below THEN above ELSE below END AS m FROM near),
pairs AS (
  SELECT p.id, c.cid AS match_id, abs(p.m - p.s) AS distance FROM picked p LEFT JOIN control c ON c.s = p.m)"""


@query("psm_match", f"""
WITH {SALES_SQL}, {SCORE_SQL}, {PSM_SQL}
SELECT id, match_id, round(distance, 6) AS distance FROM pairs""")
def psm_match(t: Tables):
    pairs = matching.nearest_match(scored_sales(t), SALES, "propensity")
    return rounded(pairs, ["distance"])


# ---- evaluation --------------------------------------------------------------------------


@query("observed_arm_prediction", f"WITH {SALES_SQL}, {SCORE_SQL} SELECT id, t, y, p FROM observed")
def observed_arm_prediction(t: Tables):
    return scored_sales(t).select("id", "t", "y", scores.observed_arm("t", "y1", "y0").alias("p"))


AUC_SQL = """(SELECT {by} round(sum(below * pos + pos * neg / 2.0::DOUBLE) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), {digits}) AS auc
  FROM (SELECT {by} pos, neg, coalesce(sum(neg) OVER ({part} ORDER BY p
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
        FROM (SELECT {by} p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {source} GROUP BY ALL)) {group})"""


def auc_sql(source: str, by: list[str] = (), digits: int = 6) -> str:
    names = ", ".join(by)
    return AUC_SQL.format(
        by=f"{names}," if by else "", part=f"PARTITION BY {names}" if by else "",
        group=f"GROUP BY {names}" if by else "", source=source, digits=digits,
    )


@query("auc_exact", f"WITH {SALES_SQL}, {SCORE_SQL} SELECT * FROM {auc_sql('observed', ['cohort'])}")
def auc_exact(t: Tables):
    return rounded(scores.auc(scored_sales(t), "y", "p", ["cohort"]), ["auc"])


@query("roc_table", f"""
WITH {SALES_SQL}, {SCORE_SQL}, g AS (
  SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM observed GROUP BY p)
SELECT p AS threshold,
  round(sum(neg) OVER (ORDER BY p DESC) / (SELECT sum(neg) FROM g)::DOUBLE, 6) AS fpr,
  round(sum(pos) OVER (ORDER BY p DESC) / (SELECT sum(pos) FROM g)::DOUBLE, 6) AS tpr FROM g""")
def roc_table(t: Tables):
    return rounded(scores.roc(scored_sales(t), "y", "p"), ["fpr", "tpr"])


@query("brier_by_arm", f"""
WITH {SALES_SQL}, {SCORE_SQL}
SELECT t, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM observed GROUP BY t""")
def brier_by_arm(t: Tables):
    return rounded(scores.brier(scored_sales(t), "y", "p", ["t"]), ["brier"])


@query("log_loss_by_arm", f"""
WITH {SALES_SQL}, {SCORE_SQL}
SELECT t, round(avg(-(y * CASE WHEN p > 0 THEN greatest(ln(p), -100.0::DOUBLE) ELSE -100 END
  + (1 - y) * CASE WHEN p < 1 THEN greatest(ln(1 - p), -100.0::DOUBLE) ELSE -100 END)), 6) AS log_loss
FROM observed GROUP BY t""")
def log_loss_by_arm(t: Tables):
    return rounded(scores.log_loss(scored_sales(t), "y", "p", ["t"]), ["log_loss"])


@query("confusion_by_arm", f"""
WITH {SALES_SQL}, {SCORE_SQL}, grid AS (
  SELECT * FROM (VALUES (0), (1)) a(t), (VALUES (0), (1)) b(actual), (VALUES (0), (1)) c(predicted))
SELECT g.t, g.actual, g.predicted, count(o.id) AS n FROM grid g LEFT JOIN observed o
  ON o.t = g.t AND o.y = g.actual AND CASE WHEN o.p > 0.5 THEN 1 ELSE 0 END = g.predicted
GROUP BY ALL""")
def confusion_by_arm(t: Tables):
    return scores.confusion(scored_sales(t), "y", "p", ["t"])


CALIBRATION_SQL = """SELECT {by} CAST(greatest(ceil(p * 10) - 1, 0) AS INTEGER) AS bin,
  round(avg(p), 6) AS mean_predicted, round(avg(CAST(y AS DOUBLE)), 6) AS observed, count(*) AS n
  FROM observed GROUP BY ALL"""


@query("calibration_table", f"WITH {SALES_SQL}, {SCORE_SQL} {CALIBRATION_SQL.format(by='')}")
def calibration_table(t: Tables):
    bins = scores.calibration(scored_sales(t), "y", "p")
    return rounded(bins, ["mean_predicted", "observed"])


@query("curves_by_cohort", f"""
WITH {SALES_SQL}, {SCORE_SQL}, g AS (
  SELECT cohort, p, sum(y) AS pos, sum(1 - y) AS neg FROM observed GROUP BY cohort, p),
tot AS (SELECT cohort, sum(pos)::DOUBLE AS m1, sum(neg)::DOUBLE AS m0 FROM g GROUP BY cohort),
cal AS ({CALIBRATION_SQL.format(by='cohort,')})
SELECT g.cohort, 'roc' AS curve,
  round(sum(neg) OVER (PARTITION BY g.cohort ORDER BY p DESC) / m0, 6) AS x,
  round(sum(pos) OVER (PARTITION BY g.cohort ORDER BY p DESC) / m1, 6) AS y
FROM g JOIN tot ON tot.cohort = g.cohort
UNION ALL SELECT cohort, 'calibration', mean_predicted, observed FROM cal""")
def curves_by_cohort(t: Tables):
    scored = stage(scored_sales(t).select("cohort", "y", "p"), "scored")
    return rounded(scores.curves(scored, "y", "p", "cohort"), ["x", "y"])


@query("model_summary", f"""
WITH {SALES_SQL}, {SCORE_SQL}, s AS (
  SELECT 'treated_head' AS model, cohort, y, y1 AS p FROM observed
  UNION ALL SELECT 'control_head', cohort, y, y0 FROM observed
  UNION ALL SELECT 'observed_arm', cohort, y, p FROM observed),
a AS (SELECT * FROM {auc_sql('s', ['model', 'cohort'], 9)})
SELECT model, round(max(CASE WHEN cohort = 'internal' THEN auc END), 2) AS auc_internal,
  round(max(CASE WHEN cohort = 'external' THEN auc END), 2) AS auc_external FROM a GROUP BY model""")
def model_summary(t: Tables):
    scored = stage(scored_sales(t).select("cohort", "y", "y1", "y0", "p"), "scored")
    models = {"treated_head": "y1", "control_head": "y0", "observed_arm": "p"}
    frames = {m: scored.select("cohort", "y", F.col(c).alias("p")) for m, c in models.items()}
    return scores.summary(frames, "y", "p", "cohort", ["internal", "external"])


# ---- interpretation ----------------------------------------------------------------------

GROUP_SQL = """grouped AS (SELECT *, CASE WHEN ite <= -0.1 THEN 'responder' WHEN ite >= 0.1 THEN 'harmed'
  ELSE 'neutral' END AS grp FROM observed)"""


def grouped(t: Tables) -> DataFrame:
    return scored_sales(t).withColumn("grp", interpretation.responder_group("ite"))


@query("responder_groups", f"""
WITH {SALES_SQL}, {SCORE_SQL}, {GROUP_SQL}
SELECT grp, count(*) AS n, round(avg(ite), 6) AS mean_ite FROM grouped GROUP BY grp""")
def responder_groups(t: Tables):
    return grouped(t).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ite"), 6).alias("mean_ite")
    )


@query("ate_summary", f"""
WITH {SALES_SQL}, {SCORE_SQL}
SELECT round(avg(ite), 6) AS ate, round(stddev_pop(ite), 6) AS sd, count(ite) AS n FROM scored""")
def ate_summary(t: Tables):
    return rounded(interpretation.ate(scored_sales(t), "ite"), ["ate", "sd"])


@query("sorted_output", f"""
WITH {SALES_SQL}, {SCORE_SQL}
SELECT id, ite, row_number() OVER (ORDER BY ite DESC NULLS LAST, id) AS position FROM scored""")
def sorted_output(t: Tables):
    """Effects written in order and read back with their place in the files."""
    path = scratch(t.spark, "sorted")
    write_sorted(scored_sales(t).select("id", "ite"), path, [F.desc_nulls_last("ite"), F.asc("id")])
    return read_positions(t.spark, path)


FREQUENCIES, PHASES = (x.tolist() for x in distance.frequencies(len(X), 12, 1.0))
DISCREPANCY_SQL = " + ".join(
    f"(avg(CASE WHEN t = 1 THEN {wave} END) - avg(CASE WHEN t = 0 THEN {wave} END)) ** 2"
    for wave in (
        "cos(" + " + ".join([f"{w!r}::DOUBLE * {c}" for w, c in zip(row, X)]) + f" + {phase!r}::DOUBLE)"
        for row, phase in zip(FREQUENCIES, PHASES)
    )
)


@query("mean_discrepancy", f"""
WITH {SCALED_SQL}
SELECT round(({DISCREPANCY_SQL}) / 6, 6) AS mmd2, count(CASE WHEN t = 1 THEN 1 END)::DOUBLE AS n1,
       count(CASE WHEN t = 0 THEN 1 END)::DOUBLE AS n0 FROM scaled""")
def mean_discrepancy(t: Tables):
    """How far apart the arms are in all covariates together, by twelve random cosines."""
    done = prepared(t)[0].withColumn("x", F.array(*[F.col(c).cast("double") for c in X]))
    return rounded(distance.mean_discrepancy(done, "x", len(X), "t", features=12, scale=1.0), ["mmd2"])


@query("representation_distance")
def representation_distance(t: Tables):
    """The arms' distance before matching, after it, and in the network's representation."""
    done, train = prepared(t)
    done = stage(done.withColumn("x", F.array(*[F.col(c).cast("double") for c in X])), "prepared")
    scored = learners.propensity_score(train, done, SALES)
    pairs = stage(matching.nearest_match(scored, SALES, "propensity"), "pairs")
    model = two_head.fit_two_head(train, SALES, width=16, epochs=400, lr=1e-3)
    return distance.by_phase(
        {
            "before": (done, "x", len(X)),
            "matched": (matching.matched_set(done, SALES, pairs), "x", len(X)),
            "represented": (model.represent(done), "representation", model.width),
        },
        "t",
    )


@query("joint_transport")
def joint_transport(t: Tables):
    """Transport cost between the arms in all covariates together, before matching and after it."""
    done, train = prepared(t)
    done = stage(done.withColumn("x", F.array(*[F.col(c).cast("double") for c in X])), "prepared")
    pairs = stage(matching.nearest_match(learners.propensity_score(train, done, SALES), SALES, "propensity"), "pairs")
    before, after = (
        transport.joint_transport(rows, "x", len(X), "t").select(F.lit(phase).alias("phase"), "*")
        for phase, rows in (("before", done), ("matched", matching.matched_set(done, SALES, pairs)))
    )
    return before.unionByName(after)


@query("subgroup_describe", f"""
WITH {SALES_SQL}, {SCORE_SQL}, {GROUP_SQL}, long AS ({" UNION ALL ".join(
    f"SELECT grp, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM grouped" for c in X)})
SELECT grp, feature, count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
  round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS p25, round(median(v), 4) AS p50,
  round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max
FROM long GROUP BY grp, feature""")
def subgroup_describe(t: Tables):
    table = stage(grouped(t).select("grp", *X), "grouped")
    described = interpretation.describe_by(table, "grp", X)
    return rounded(described, ["mean", "std", "min", "p25", "p50", "p75", "max"], 4)


@query("ite_curve", f"""
WITH {SALES_SQL}, {SCORE_SQL}
SELECT id, row_number() OVER (ORDER BY ite, id) AS rank, ite,
  round(ite - (SELECT stddev_pop(ite) FROM scored), 6) AS lower,
  round(ite + (SELECT stddev_pop(ite) FROM scored), 6) AS upper,
  CASE WHEN ite > 0.1 THEN 'above' WHEN ite < -0.1 THEN 'below' ELSE 'between' END AS segment
FROM scored""")
def ite_curve(t: Tables):
    scored = stage(scored_sales(t).select("id", "ite"), "scored")
    return rounded(interpretation.ordered_curve(scored, "ite", "id"), ["lower", "upper"])


BOOT = 1000
BOOT_COLS = ["c_acctbal", "n_orders", "max_qty"]
POISSON_CASE = " ".join(
    f"WHEN u < {b!r}::DOUBLE THEN {k}" for k, b in enumerate(interpretation.POISSON_ONE)
)


@query("bootstrap_ci", f"""
WITH {SALES_SQL}, {SCORE_SQL}, {GROUP_SQL}, base AS MATERIALIZED (SELECT id, grp, {", ".join(BOOT_COLS)} FROM grouped),
draws AS (
  SELECT b.*, r.r, CAST(('0x' || substr(md5('42|' || CAST(id AS VARCHAR) || '|' || CAST(r.r // 4 AS VARCHAR)),
      CAST(8 * (r.r % 4) + 1 AS BIGINT), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM base b, range({BOOT}) r(r)),
weighted AS (SELECT *, CASE {POISSON_CASE} ELSE {len(interpretation.POISSON_ONE)} END AS w FROM draws),
means AS ({" UNION ALL ".join(
    f"SELECT grp, r, '{c}' AS feature, sum(w * {c})::DOUBLE / nullif(sum(CASE WHEN {c} IS NOT NULL THEN w END), 0)::DOUBLE AS m FROM weighted GROUP BY grp, r"
    for c in BOOT_COLS)}),
ci AS (SELECT grp, feature, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high
       FROM means GROUP BY grp, feature),
plain AS ({" UNION ALL ".join(
    f"SELECT grp, '{c}' AS feature, avg({c}) AS mean, median(CAST({c} AS DOUBLE)) AS median, count({c}) AS n FROM base GROUP BY grp"
    for c in BOOT_COLS)})
SELECT p.grp, p.feature, round(p.mean, 4) AS mean, round(p.median, 4) AS median,
       round(ci.low, 4) AS low, round(ci.high, 4) AS high
FROM plain p JOIN ci ON ci.grp = p.grp AND ci.feature = p.feature WHERE p.n > 2""")
def bootstrap_ci(t: Tables):
    table = stage(grouped(t).select("id", "grp", *BOOT_COLS), "grouped")
    intervals = interpretation.bootstrap(table, "id", BOOT_COLS, "grp", resamples=BOOT)
    return rounded(intervals, ["mean", "median", "low", "high"], 4)


# ---- distances ---------------------------------------------------------------------------

PHASES_SQL = f"""phases AS (
  SELECT 'before' AS phase, t, {", ".join(X)} FROM scored
  UNION ALL SELECT 'after', t, {", ".join(X)} FROM scored WHERE t = 1
  UNION ALL SELECT 'after', s.t, {", ".join(f"s.{c}" for c in X)} FROM pairs p JOIN scored s ON s.id = p.match_id)"""
LONG_SQL = " UNION ALL ".join(
    f"SELECT phase, '{c}' AS feature, t, CAST({c} AS DOUBLE) AS v FROM phases WHERE {c} IS NOT NULL" for c in X
)


def phases(t: Tables) -> dict[str, DataFrame]:
    """The sales cohort as it is, and its treated with their nearest controls."""
    scored = stage(scored_sales(t), "scored")
    pairs = matching.nearest_match(scored, SALES, "propensity")
    return {"before": scored, "after": matching.matched_set(scored, SALES, pairs)}


def wasserstein_sql(long: str, by: str) -> str:
    """w1 from the area between the distribution functions, w2 from the quantile functions."""
    return f"""cnt AS (SELECT {by}, v, sum(t) AS n1, sum(1 - t) AS n0 FROM ({long}) GROUP BY {by}, v),
cum AS (SELECT *, sum(n1) OVER w / sum(n1) OVER (PARTITION BY {by})::DOUBLE AS f1,
          sum(n0) OVER w / sum(n0) OVER (PARTITION BY {by})::DOUBLE AS f0,
          lead(v) OVER w AS nxt
        FROM cnt WINDOW w AS (PARTITION BY {by} ORDER BY v)),
one AS (SELECT {by}, sum(abs(f1 - f0) * (nxt - v)) AS w1 FROM cum GROUP BY {by}),
steps AS (SELECT {by}, f1 AS u, v AS q1, NULL::DOUBLE AS q0 FROM cum WHERE n1 > 0
          UNION ALL SELECT {by}, f0, NULL, v FROM cum WHERE n0 > 0),
levels AS (SELECT {by}, u, max(q1) AS q1, max(q0) AS q0 FROM steps GROUP BY {by}, u),
merged AS (SELECT {by}, u - coalesce(lag(u) OVER (PARTITION BY {by} ORDER BY u), 0) AS mass,
    first_value(q1 IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1,
    first_value(q0 IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x0
  FROM levels),
two AS (SELECT {by}, sum(mass * (x1 - x0) * (x1 - x0)) AS w2 FROM merged GROUP BY {by})"""


@query("wasserstein_1d", f"""
WITH {SALES_SQL}, {SCORE_SQL}, {PSM_SQL}, {PHASES_SQL}, {wasserstein_sql(LONG_SQL, 'phase, feature')}
SELECT phase, feature, round(w1, 4) AS w1, round(w2, 2) AS w2_squared FROM one JOIN two USING (phase, feature)""")
def wasserstein_1d(t: Tables):
    stacked = reduce(lambda a, b: a.unionByName(b), [
        unpivot(df, ["t"], X, "feature", "value").withColumn("phase", F.lit(phase))
        for phase, df in phases(t).items()
    ])
    costs = distance.wasserstein(stacked, ["phase", "feature"], "value", "t")
    return costs.select(
        "phase", "feature", F.round("w1", 4).alias("w1"), F.round("w2_squared", 2).alias("w2_squared")
    )


@query("balance_smd", f"""
WITH {SALES_SQL}, {SCORE_SQL}, {PSM_SQL}, {PHASES_SQL}
{" UNION ALL ".join(
    f"SELECT phase, '{c}' AS feature, round(avg(CASE WHEN t = 1 THEN {c} END), 4) AS mean_treated, "
    f"round(avg(CASE WHEN t = 0 THEN {c} END), 4) AS mean_control, round({_smd_sql(c)}, 4) AS smd FROM phases GROUP BY phase"
    for c in X)}""")
def balance_smd(t: Tables):
    tables = [
        distance.balance(df, SALES).withColumn("phase", F.lit(phase)) for phase, df in phases(t).items()
    ]
    return rounded(tables[0].unionByName(tables[1]), ["mean_treated", "mean_control", "smd"], 4)


# Fixed divisors bring the covariates to comparable size before they are projected.
SIZES = {"c_acctbal": 10000.0, "n_orders": 20.0, "mean_price": 500000.0, "max_qty": 50.0, "mean_discount": 0.1}
PROJECTIONS = 16


def _projection_sql() -> str:
    out = []
    for i, d in enumerate(distance.directions(len(X), PROJECTIONS)):
        dot = " + ".join(f"({c} / {SIZES[c]!r}::DOUBLE) * {w!r}::DOUBLE" for c, w in zip(X, d))
        out.append(f"SELECT 'p{i}' AS projection, t, round({dot}, 6) AS v FROM filled")
    return " UNION ALL ".join(out)


@query("sliced_wasserstein", f"""
WITH {SALES_SQL}, filled AS (SELECT t, {", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT round(median(CAST({c} AS DOUBLE)), 6) FROM sales)) AS {c}" for c in X)}
  FROM sales), {wasserstein_sql(_projection_sql(), 'projection')}
SELECT round(avg(w1), 6) AS sliced_w1, round(avg(w2), 6) AS sliced_w2_squared
FROM one JOIN two ON two.projection = one.projection""")
def sliced_wasserstein(t: Tables):
    table = stage(sales(t), "analysis")
    medians = {c: round(p["median"], 6) for c, p in scaling.params_of(scaling.fit_params(table, X)).items()}
    filled = cleaning.fill_from(table.select("t", *X), medians)
    sized = filled.withColumns({c: F.col(c) / F.lit(s) for c, s in SIZES.items()})
    result = distance.sliced_wasserstein(sized, SALES, PROJECTIONS, digits=6)
    return rounded(result, ["sliced_w1", "sliced_w2_squared"])


# ---- end to end --------------------------------------------------------------------------


@query("effect_study")
def effect_study(t: Tables):
    """Split, scale, impute, T-learner, observed-arm AUC, responder groups with their size and effect."""
    done, train = prepared(t)
    model = learners.fit_effect(train, SALES, "t", "lr")
    scored = stage(model.score(done).select("id", "split", "t", "y", "y0", "y1", "ite"), "effects")
    test = scored.filter("split = 'test'").withColumn("p", scores.observed_arm("t", "y1", "y0"))
    quality = scores.evaluate(test, Roles("id", "t", "y", ()), "p").first()
    groups = scored.withColumn("grp", interpretation.responder_group("ite")).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ite").alias("mean_ite")
    )
    return groups.withColumn("test_auc", F.lit(quality["auc"])).withColumn(
        "test_brier", F.lit(quality["brier"])
    )
