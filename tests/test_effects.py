"""Learners on rows with a planted effect."""

from multiprocessing.pool import ThreadPool
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirador.effects import learners, matching, strata, tuning, two_head
from mirador.effects.store import load_effect, save_effect
from mirador.metrics import distance, scores
from mirador.prep import ranking, split
from mirador.roles import Roles
from mirador.studies import Study
from mirador.studies.study import compare

ROLES = Roles("id", "t", "y", ("x1", "x2"))
TRUTH = 0.25
QUICK = {"lr": {}, "gbt": {"maxIter": 10}, "mlp": {"hidden": 8, "maxIter": 80}}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    n = 4000
    x1, x2 = rng.random(n), rng.random(n)
    t = (rng.random(n) < 0.3 + 0.4 * x1).astype(int)
    y = (rng.random(n) < 0.2 + 0.3 * x1 + TRUTH * t).astype(int)
    return spark.createDataFrame(
        pd.DataFrame({"id": np.arange(n), "t": t, "y": y, "x1": x1, "x2": x2})
    ).repartition(4).cache()


@pytest.mark.parametrize("learner", learners.LEARNERS)
@pytest.mark.parametrize("base", learners.BASES)
def test_mean_effect(planted, learner, base):
    model = learners.fit_effect(planted, ROLES, learner, base, **QUICK[base])
    scored = model.score(planted)
    assert scored.columns == [*planted.columns, "y0", "y1", "ite"]
    assert scored.agg(F.avg("ite")).first()[0] == pytest.approx(TRUTH, abs=0.07)


def test_unknown_names_are_refused(planted):
    with pytest.raises(ValueError):
        learners.fit_effect(planted, ROLES, "q", "lr")
    with pytest.raises(ValueError):
        learners.fit_effect(planted, ROLES, "t", "svm")


def test_matching(planted):
    model, pairs = matching.fit_matched(planted, ROLES)
    got = matching.matched_effect(model, planted, pairs)
    assert got.count() == planted.filter("t = 1").count()
    assert got.agg(F.avg("ite")).first()[0] == pytest.approx(TRUTH, abs=0.1)


def test_doubly_robust(planted):
    scored = learners.fit_effect(planted, ROLES, "t", "lr").score(planted)
    scored = learners.propensity_score(planted, scored, ROLES)
    for table in (strata.aipw(scored, ROLES, "y1", "y0", "propensity"), strata.ipw(scored, ROLES, "propensity")):
        assert table.first()["ate"] == pytest.approx(TRUTH, abs=0.05)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    x, t, y = rng.normal(size=(20, 3)), rng.integers(0, 2, 20), rng.integers(0, 2, 20)
    weights = two_head.initial(3, 5, 1)
    args = (1 / max(t.sum(), 1), 1 / max((1 - t).sum(), 1))
    _, grad = two_head.loss_and_gradient(x, t, y, *args, weights, 5)
    for i in rng.integers(0, len(weights), 25):
        step = np.zeros_like(weights)
        step[i] = 1e-6
        up, _ = two_head.loss_and_gradient(x, t, y, *args, weights + step, 5)
        down, _ = two_head.loss_and_gradient(x, t, y, *args, weights - step, 5)
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_two_head(planted, spark, tmp_path):
    model = two_head.fit_two_head(planted, ROLES, width=8, epochs=40, lr=0.01)
    assert model.losses[-1] < model.losses[0]
    scored = model.score(planted)
    assert scored.agg(F.avg("ite")).first()[0] == pytest.approx(TRUTH, abs=0.1)
    save_effect(spark, model, str(tmp_path / "net"))
    again = load_effect(spark, str(tmp_path / "net")).score(planted)
    a, b = (f.agg(F.sum("ite")).first()[0] for f in (scored, again))
    assert a == pytest.approx(b)


def test_one_task_and_many_train_alike(planted):
    """Several networks together: in one task each, by epoch over partitions, and alone."""
    nets = [two_head.Net(2, 6, 25, 1e-2, 1), two_head.Net(1, 9, 10, 3e-3, 2), two_head.Net(2, 4, 1, 1e-1, 3)]
    small = two_head.fit_networks(planted, ROLES, nets)
    large = two_head.fit_networks(planted, ROLES, nets, task_cells=0)
    many = two_head.fit_networks(planted.repartition(40), ROLES, nets[1:2], task_cells=0)  # added up in two steps
    for net, a, b in zip(nets, small, large):
        alone = two_head.fit_two_head(planted, ROLES.with_x(ROLES.x[: net.inputs]), net.width, net.epochs, net.lr, net.seed)
        assert len(a.losses) == len(b.losses) == net.epochs and a.roles.x == b.roles.x == ROLES.x[: net.inputs]
        assert np.allclose(a.weights, b.weights, atol=2e-4) and np.allclose(a.losses, b.losses, rtol=1e-4)
        assert np.array_equal(a.weights, alone.weights)
    assert np.allclose(many[0].weights, small[1].weights, atol=2e-4)


def test_networks_train_beside_each_other(planted, spark):
    """As many tasks of one job as networks, which start before the first one ends."""
    context = spark.sparkContext
    nets = [two_head.Net(2, 24, 400, 1e-3, seed) for seed in range(4)]
    context.setJobGroup("networks-together", "")
    try:
        models = two_head.fit_networks(planted, ROLES, nets)
    finally:
        context._jsc.clearJobGroup()
    assert len(models) == 4 and all(len(m.losses) == 400 for m in models)
    tracker = context.statusTracker()
    last = tracker.getJobInfo(max(tracker.getJobIdsForGroup("networks-together")))
    assert tracker.getStageInfo(max(last.stageIds)).numTasks == 4


def test_blocks_and_threads_change_no_sum():
    rng = np.random.default_rng(5)
    x, arm, y = rng.normal(size=(9000, 3)), (rng.random(9000) < 0.4).astype(float), (rng.random(9000) < 0.5).astype(float)
    weights = two_head.initial(3, 16, 2)
    blocks = two_head._blocks(9000, 16)
    assert len(blocks) > 1
    whole = two_head._of_block(x, arm, y, 0.1, 0.2, weights, 16)
    split = two_head.loss_and_gradient(x, arm, y, 0.1, 0.2, weights, 16)
    assert split[0] == pytest.approx(whole[0]) and np.allclose(split[1], whole[1])
    with ThreadPool(3) as pool:
        threaded = two_head._gradient((x, arm, y), (0.1, 0.2), weights, 16, pool.imap)
    assert np.array_equal(threaded[1], two_head._gradient((x, arm, y), (0.1, 0.2), weights, 16)[1])


def test_members_of_a_team_change_no_sum():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(9000, 3)).astype(np.float32), (rng.random(9000) < 0.5).astype(np.float32)
    arm = np.sort(rng.random(9000) < 0.4).astype(np.float32)
    net, weights = two_head.Net(3, 40), two_head.initial(3, 40, 2).astype(np.float32)
    loss, grad = two_head._gradient((x, arm, y), (0.1, 0.2), weights, 40)
    found = []
    for members in (1, 3):
        with two_head.Team((x, arm, y), (0.1, 0.2), net, members) as team:
            assert team.members == members and len({h.pid for h, _ in team.helpers}) == members - 1
            found += [team.gradient(weights * 2), team.gradient(weights)]
        assert not any(h.is_alive() for h, _ in team.helpers)
    assert found[1][0] == found[3][0] and np.array_equal(found[1][1], found[3][1])
    assert np.array_equal(found[0][1], found[2][1]) and not np.allclose(found[0][1], found[1][1])
    assert found[1][0] == pytest.approx(loss) and np.allclose(found[1][1], grad, atol=1e-6 * np.abs(grad).max())


def test_a_lone_network_has_all_cores_of_an_executor(spark):
    """Also where the master alone says how many those are."""
    cores = spark.sparkContext.defaultParallelism
    assert two_head._members(spark.sparkContext, [two_head.Net(5)]) == [min(cores, two_head.EVEN)]
    cluster = SimpleNamespace(master="local-cluster[3,4,9000]", defaultParallelism=12, getConf=dict)
    assert two_head._members(cluster, [two_head.Net(5)]) == [4]


def test_a_search_shares_out_the_cores_by_work():
    cluster = SimpleNamespace(master="local-cluster[3,4,9000]", defaultParallelism=12, getConf=dict)
    nets = [two_head.Net(5, 100, 16_000), two_head.Net(5, 100, 8_000), *[two_head.Net(5, 20, 1_000)] * 8]
    assert two_head._members(cluster, nets) == [4, 4, *[1] * 8]
    assert two_head._members(SimpleNamespace(master="spark://a:1", defaultParallelism=12, getConf=dict), nets) == [1] * 10


def test_blocks_hold_arms_of_all_kinds():
    """Arrays that are used again keep nothing of the block before, whatever arms its rows are of."""
    rng = np.random.default_rng(6)
    x, y, weights = rng.normal(size=(50, 3)), (rng.random(50) < 0.5).astype(float), two_head.initial(3, 9, 2)
    for arm in (np.ones(50), (rng.random(50) < 0.4).astype(float), np.zeros(50), np.full(50, 0.25)):
        rows = [two_head._of_block(x[k:k + 1], arm[k:k + 1], y[k:k + 1], 0.1, 0.2, weights, 9) for k in range(50)]
        loss, grad = two_head._of_block(x, arm, y, 0.1, 0.2, weights, 9)
        assert loss == pytest.approx(sum(a for a, _ in rows)) and np.allclose(grad, sum(g for _, g in rows))


def test_blocks_take_no_missing_values(planted):
    """A missing value stops the training by epochs, as it did before there were blocks."""
    with pytest.raises(Exception, match="missing"):
        two_head.fit_two_head(planted.withColumn("x1", F.when(F.col("id") != 3, F.col("x1"))), ROLES, 4, 1, task_cells=0)


def test_epochs_read_blocks_over_all_cores(planted, spark):
    """A table in one partition is dealt out; its blocks hold every row once."""
    data = planted.selectExpr("x1 AS _x0", "x2 AS _x1", "double(t) AS _t", "double(y) AS _y").coalesce(1)
    rows = np.concatenate([np.frombuffer(r["_rows"], np.float32).reshape(-1, 4) for r in two_head._packed(data).collect()])
    want = data.select("_t", "_y", "_x0", "_x1").toPandas().to_numpy(np.float32)
    assert np.array_equal(rows[np.lexsort(rows.T)], want[np.lexsort(want.T)])


def test_summed_gradient_is_that_of_one_machine(planted):
    pdf = planted.toPandas()
    columns = [pdf[c].to_numpy(float) for c in ("t", "y")]
    scales = (1 / pdf["t"].sum(), 1 / (1 - pdf["t"]).sum())
    weights = two_head.initial(2, 7, 4)
    loss, grad = two_head.loss_and_gradient(pdf[["x1", "x2"]].to_numpy(float), *columns, *scales, weights, 7)
    data = planted.selectExpr("x1 AS _x0", "x2 AS _x1", "double(t) AS _t", "double(y) AS _y").repartition(30)
    for adders in (1, 5):
        total = two_head._added(data, {0: (two_head.Net(2, 7), weights)}, scales, adders)[0]
        assert total[-1] == pytest.approx(loss, rel=1e-5) and np.allclose(total[:-1], grad, atol=1e-5)


def test_defaults_are_the_source_settings():
    import inspect

    given = {k: p.default for k, p in inspect.signature(two_head.fit_two_head).parameters.items()}
    assert (given["width"], given["epochs"], given["lr"]) == (108, 11_197, 5.318e-6)


def test_search_of_networks(planted):
    space = {"lr": (1e-3, 1e-2, "log"), "epochs": (5, 30, "int"), "width": (4, 9, "int"), "features": (1, 2, "int")}
    trials = tuning.search(planted, ROLES, space, trials=3, learner="two_head").orderBy("trial").collect()
    assert set(tuning.NETWORK_SPACE) == set(space) == set(trials[0]["params"])
    data = split.hash_split(planted, "id", 0.8, 43, "_part")
    for r in trials:
        p = r["params"]
        used = ROLES.with_x(ROLES.x[: int(p["features"])])
        alone = two_head.fit_two_head(data.filter("_part = 'train'"), used, int(p["width"]), int(p["epochs"]), p["lr"])
        scored = alone.score(data.filter("_part = 'test'")).withColumn("p", F.when(F.col("t") == 1, F.col("y1")).otherwise(F.col("y0")))
        assert scores.auc(scored, "y", "p").first()["auc"] == pytest.approx(r["auc"], abs=1e-6)


def test_representation_and_its_distance(planted):
    model = two_head.fit_two_head(planted, ROLES, width=8, epochs=30, lr=0.01)
    shown = model.represent(planted).limit(50).toPandas()
    want = two_head.representation(shown[["x1", "x2"]].to_numpy(float), model.weights, 8)
    assert np.allclose(np.stack(shown["representation"]), want)
    rows = planted.withColumn("v", F.array("x1", "x2"))
    got = distance.mean_discrepancy(rows, "v", 2, "t", features=4000, scale=0.5).first()
    pdf = planted.toPandas()
    a, b = (pdf.loc[pdf["t"] == k, ["x1", "x2"]].to_numpy() for k in (1, 0))
    kernel = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(axis=2) / (2 * 0.25)).mean()
    assert got["mmd2"] == pytest.approx(kernel(a, a) + kernel(b, b) - 2 * kernel(a, b), abs=2e-3)
    assert (got["n1"], got["n0"]) == (len(a), len(b))


def test_discrepancy_of_odd_rows(spark):
    rows = [([0.0, 1.0], 1, 2.0), ([0.0, 1.0], 0, 1.0), (None, 1, 1.0), ([1.0], 1, 1.0), ([1.0, None], 0, 1.0), ([5.0, 5.0], None, 1.0)]
    df = spark.createDataFrame(rows, "v array<double>, t int, w double")
    assert distance.mean_discrepancy(df, "v", 2, "t").first()["mmd2"] == pytest.approx(0)
    weighted = distance.mean_discrepancy(df, "v", 2, "t", weight="w").first()
    assert (weighted["n1"], weighted["n0"]) == (2.0, 1.0)
    assert distance.mean_discrepancy(df.filter("t = 1"), "v", 2, "t").first()["mmd2"] is None
    assert distance.mean_discrepancy(df.limit(0), "v", 2, "t").first()["mmd2"] is None


def test_search(planted):
    space = {"regParam": (1e-4, 1e-1, "log"), "features": (1, 2, "int")}
    trials = tuning.search(planted, ROLES, space, trials=2)
    assert trials.count() == 2 and 0.5 < trials.agg(F.max("auc")).first()[0] < 1
    assert set(tuning.best(trials)) == {"regParam", "features"}


def test_selection_prefers_the_covariate_that_matters(planted):
    got = ranking.importance(planted, ROLES).filter("feature = 'x1'").select("ranking").collect()
    assert len(got) == 4 and all(r["ranking"] == 1.0 for r in got)
    ranked = ranking.eliminate(planted, ROLES).orderBy("rank").collect()
    assert ranked[0]["feature"] == "x1"


@pytest.mark.parametrize("learner,base,params", [
    ("t", "gbt", {"maxIter": 5}), ("x", "gbt", {"maxIter": 2}), ("psm", "gbt", {"maxIter": 2}), ("psm", "lr", {}),
    ("two_head", "", {"width": 4, "epochs": 3}),
])
def test_study_saves_and_reloads(planted, spark, tmp_path, learner, base, params):
    holes = planted.withColumn("x2", F.when(F.col("id") % 5 > 0, F.col("x2")))
    study, rows = Study.fit(holes, ROLES, learner, base, ranked=["x1", "x2"], **params)
    scored = study.score(rows)
    study.save(spark, str(tmp_path / "s"))
    outside = Study.load(spark, str(tmp_path / "s")).score(holes)
    assert {r[0] for r in outside.select("split").distinct().collect()} == {"test"}
    joined = scored.select("id", "ite").join(outside.select("id", F.col("ite").alias("again")), "id")
    assert joined.filter(F.abs(F.col("ite") - F.col("again")) > 1e-9).count() == 0
    assert joined.count() == planted.count()


def test_study_reports(planted):
    study, rows = Study.fit(planted, ROLES, "t", "lr", features=2)
    assert study.ranked[0] == "x1"
    scored = study.score(rows)
    quality = study.evaluate(scored)
    assert 0.55 < quality["quality"].first()["auc"] < 0.8
    assert quality["confusion"].agg(F.sum("n")).first()[0] == rows.filter("split = 'test'").count()
    reports = study.interpret(scored, resamples=20)
    assert reports["groups"].agg(F.sum("n")).first()[0] == planted.count()
    assert reports["curve"].count() == planted.count()
    assert reports["intervals"].count() and reports["profile"].count()
    assert study.balance(rows).count() == 2


def test_matched_study(planted, spark, tmp_path):
    study, rows = Study.fit(planted, ROLES, "psm", "lr", ranked=["x1", "x2"])
    scored = study.score(rows)
    assert scored.select("x1", "x2").exceptAll(rows.select("x1", "x2")).isEmpty()  # unscaled, as they came
    treated = rows.filter("t = 1").count()
    pairs = study.match(rows)
    effects = study.matched(rows, pairs)
    assert pairs.count() == effects.count() == treated
    assert effects.agg(F.avg("ite")).first()[0] == pytest.approx(TRUTH, abs=0.15)
    assert {tuple(r) for r in study.balance(rows, pairs).select("phase", "feature").collect()} == {
        (p, x) for p in ("before", "after") for x in ("x1", "x2")
    }
    study.save(spark, str(tmp_path / "s"))
    again = Study.load(spark, str(tmp_path / "s"))
    assert again.pairs.count() == study.pairs.count()
    new = planted.withColumn("id", F.col("id") + 10**6)  # a new cohort is matched afresh
    assert again.matched(new).filter("id >= 1000000 AND match_id >= 1000000").count() == treated


def test_report_files_and_comparison(planted, spark, tmp_path):
    studies = {base: Study.fit(planted, ROLES, "t", "lr", ranked=[base])[0] for base in ("x1", "x2")}
    outside = planted.filter("id % 2 = 0")
    areas = {r["model"]: r for r in compare(studies, {"all": planted, "even": outside}).collect()}
    assert areas["x1"]["auc_all"] > areas["x2"]["auc_all"] and 0 < areas["x2"]["auc_even"] < 1
    study = studies["x1"]
    study.report(study.score(split.hash_split(planted, "id")), str(tmp_path / "r"), resamples=8)
    names = {p.name for p in (tmp_path / "r").iterdir()}
    assert names == {"quality", "confusion", "log_loss", "roc", "calibration", "ate", "groups", "profile", "intervals", "curve"}
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "groups")).count() > 0


def test_weights_stand_for_repeated_controls(planted):
    scored = learners.propensity_score(planted, planted, ROLES, "_score")
    pairs = matching.nearest_match(scored, ROLES, "_score").persist()
    repeated = learners.fit_effect(matching.matched_set(planted, ROLES, pairs), ROLES, "t", "lr", tol=1e-10)
    weighted, _ = matching.fit_matched(planted, ROLES, "lr", tol=1e-10)
    for arm in ("m0", "m1"):
        a, b = repeated.models[arm].coefficients.toArray(), weighted.models[arm].coefficients.toArray()
        assert np.allclose(a, b, atol=1e-4)
