"""Staged tables end with their workspace; fixes that need rows the named queries do not have."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from mirador.metrics import interpretation, scores
from mirador.operators import dosing, lookups, summaries
from mirador.operators.ordered import quantiles
from mirador.plans import QUERIES
from mirador.prep import scaling
from mirador.session import staging_root
from mirador.sources.tables import stage
from mirador.sources.workspace import Workspace, workspace


def test_nothing_is_left(spark, data):
    with Workspace(spark) as own:
        assert workspace(spark) is own
        inside = QUERIES["feature_stats"](spark, data).collect()
        assert os.listdir(own.path.removeprefix("file:"))
    assert inside and not os.path.exists(own.path.removeprefix("file:"))
    assert workspace(spark) is not own and own.path.startswith(staging_root(spark))


def test_workspace_ends_with_an_error(spark):
    with pytest.raises(ZeroDivisionError), Workspace(spark) as own:
        stage(spark.range(3))
        1 / 0
    assert not os.path.exists(own.path.removeprefix("file:"))


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(1, 0.3), (0, None), (0, 0.3), (1, 1.0)], "y int, p double")


def test_missing_predictions_do_not_count(scored):
    known = scored.filter("p IS NOT NULL")
    for metric in (scores.log_loss, scores.brier, scores.calibration, scores.auc):
        assert sorted(map(tuple, metric(scored, "y", "p").collect())) == sorted(map(tuple, metric(known, "y", "p").collect()))


def test_dense_days_of_null_keys(spark):
    rows = [(None, dt.datetime(2024, 1, 1), 5.0), (None, dt.datetime(2024, 1, 3), 6.0)]
    df = spark.createDataFrame(rows, "unit int, ts timestamp_ntz, dose double")
    daily = dosing.per_day(df, ["unit"], "ts", "dose", dense=True).orderBy("day").collect()
    assert [r.total for r in daily] == [5.0, 0.0, 6.0]


def test_null_groups_keep_their_statistics(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", float(i)) for i in range(10)], "id int, grp string, x double")
    described = {r.grp: r for r in interpretation.describe_by(df, "grp", ["x"]).collect()}
    assert described[None].p50 == 5.0 and described["a"].p50 == 4.0
    assert {r.grp for r in interpretation.bootstrap(df, "id", ["x"], "grp", 20).collect()} == {None, "a"}


def test_window_of_one_instant(spark):
    at = dt.datetime(2024, 1, 1)
    facts = spark.createDataFrame([(1, at, 2.0), (1, at, 3.0), (1, at + dt.timedelta(microseconds=1), 9.0)], "person int, ts timestamp_ntz, v double")
    stays = spark.createDataFrame([(7, 1, at)], "stay int, person int, start timestamp_ntz")
    zero = dt.timedelta(0)
    got = lookups.rollup_window(facts, stays, "person", "stay", "ts", "start", zero, zero, {"total": ("sum", "v"), "n": ("count", "v")})
    assert [tuple(r) for r in got.select("stay", "total", "n").collect()] == [(7, 5.0, 2)]


@pytest.mark.parametrize("size", [10**6, 7])
def test_statistics_do_not_depend_on_the_bucket_size(spark, size):
    values = [0.0, -0.0, float("nan"), None, 1.5] + [2.0] * 30 + [float(i) for i in range(20)]
    df = spark.createDataFrame([(None if i % 3 == 0 else "hot", v) for i, v in enumerate(values)], "k string, v double")
    clean = [(k, v) for k, v in ((r.k, r.v) for r in df.collect()) if v is not None and v == v]
    got = {r.k: r for r in summaries.item_stats(df, ["k"], "v", size).collect()}
    for key in (None, "hot"):
        own = sorted(v for k, v in clean if k == key)
        middle = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
        assert (got[key].median, got[key].min, got[key].max) == (middle, own[0], own[-1])
    assert quantiles(df, [], "v", {"m": 0.5}, size).count() == 1
    wide = df.withColumn("none", F.lit(None).cast("double"))
    fitted = scaling.params_of(scaling.fit_params(wide, ["v", "none"], rows_per_bucket=size))
    assert fitted["none"]["median"] is None and fitted["v"]["max"] == 19.0


def test_long_step_tables(spark):
    steps = [("g", float(i), float(i + 1) if i % 2 else i + 0.5, i / 1000) for i in range(700)]
    points = [("g", x / 4) for x in range(-4, 2900, 7)] + [("h", 1.0), (None, 1.0), ("g", None)]
    df = spark.createDataFrame(points, "grp string, x double")
    short = lambda g, x: next((v for k, lo, hi, v in steps if k == g and x is not None and lo <= x < hi), 9.0)
    want = sorted((str(g), str(x), short(g, x)) for g, x in points)
    inline = df.withColumn("step", dosing.step_value("grp", "x", steps, 9.0))
    table = spark.createDataFrame(steps, "grp string, lo double, hi double, value double")
    for got in (inline, dosing.join_steps(df, "grp", "x", table, 9.0)):
        assert sorted((str(r.grp), str(r.x), r.step) for r in got.collect()) == want


def test_poisson_weights_reach_the_resolution_of_the_draw():
    assert 1 - interpretation.POISSON_ONE[-1] < 2**-32 <= 1 - interpretation.POISSON_ONE[-2]
