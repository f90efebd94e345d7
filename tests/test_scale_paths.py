"""Operators with a bucketed path: tiny buckets must give the answers of one bucket."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirador.effects.matching import nearest_match
from mirador.functions.timing import HOUR
from mirador.metrics import distance, interpretation, scores
from mirador.operators import lookups
from mirador.prep import scaling
from mirador.roles import Roles

ROLES = Roles("id", "t", "y", ("x1", "x2"))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 900
    x1, x2 = np.round(rng.normal(size=n), 1), np.round(rng.normal(size=n), 2)
    t = (rng.random(n) < 0.4).astype(int)
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "t": t, "y": (rng.random(n) < 1 / (1 + np.exp(-x1))).astype(int),
        "x1": x1 + 0.3 * t, "x2": x2, "p": np.round(1 / (1 + np.exp(-x1 - x2)), 3),
        "ite": np.round(rng.normal(0, 0.1, n), 2), "cohort": rng.choice(["a", "b"], n),
    })).cache()


@pytest.fixture(scope="module")
def timeline(spark):
    rng = np.random.default_rng(7)
    n = 800
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(pd.DataFrame({
        "rid": np.arange(n), "u": np.where(rng.random(n) < 0.5, 1, rng.integers(2, 8, n)),
        "ts": [start + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 20000, n)],
        "kind": rng.integers(1, 4, n), "v": np.round(rng.random(n), 2),
    })).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def same(a, b, keys):
    a, b = (f.toPandas().sort_values(keys, ignore_index=True) for f in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    return a


def sides(timeline):
    probe = timeline.filter("kind = 3").select("rid", "u", "ts")
    ref = timeline.filter("kind < 3").select(
        F.col("rid").alias("ref_id"), "u", F.col("ts").alias("ref_ts"), "kind", "v"
    )
    return probe, ref


def test_asof(timeline):
    probe, ref = sides(timeline)
    lo, hi = 5 * HOUR, 2 * HOUR

    def match(**kw):
        return lookups.asof_match(
            probe, ref, "u", "ts", "ref_ts", lo, hi, ["ref_id", "kind", "v"], kind=F.col("kind"),
            kinds=[1, 2], tie=[-F.col("v"), F.col("ref_id")], **kw,
        )

    got = same(match(), match(rows_per_bucket=40), ["rid"])
    p, r = probe.toPandas(), ref.toPandas()
    for row in p.itertuples():
        c = r[(r.u == row.u) & (r.ref_ts > row.ts - lo) & (r.ref_ts < row.ts + hi)].copy()
        c["after"], c["gap"], c["neg"] = c.ref_ts > row.ts, (c.ref_ts - row.ts).abs(), -c.v
        c = c.sort_values(["kind", "after", "gap", "neg", "ref_id"])
        found = got[got.rid == row.rid].ref_id.iloc[0]
        assert (pd.isna(found) and c.empty) or found == c.ref_id.iloc[0]


def test_band_join(timeline):
    probe, ref = sides(timeline)
    lo, hi = 7 * HOUR, 30 * HOUR / 60
    got = lookups.band_pairs(probe, ref, "u", "ts", "ref_ts", lo, hi).toPandas()
    p, r = probe.toPandas(), ref.toPandas()
    pairs = p.merge(r, on="u")
    pairs = pairs[(pairs.ref_ts > pairs.ts - lo) & (pairs.ref_ts < pairs.ts + hi)]
    want = set(zip(pairs.rid, pairs.ref_id))
    have = got.dropna(subset="ref_id")
    assert set(zip(have.rid, have.ref_id.astype(int))) == want and len(have) == len(want)
    assert set(got[got.ref_id.isna()].rid) == set(p.rid) - {a for a, _ in want}
    folded = lookups.band_join(probe, ref, "u", "rid", "ts", "ref_ts", lo, hi, {"n": ("count", "ref_id")},
                               rows_per_bucket=60).toPandas().set_index("rid").n
    assert folded.to_dict() == {r: sum(a == r for a, _ in want) for r in p.rid}


def test_rollup_window(timeline):
    stays = timeline.filter("kind = 3").select("rid", "u", F.col("ts").alias("intime"))
    lo, hi = -25 * HOUR, 9 * HOUR
    aggregates = {"low": ("min", "v"), "high": ("max", "v"), "n": ("count", "v")}
    rolled = [
        lookups.rollup_window(timeline, stays, "u", "rid", "ts", "intime", lo, hi, aggregates, **kw)
        for kw in ({}, {"rows_per_bucket": 50})
    ]
    got = same(*rolled, ["rid"]).set_index("rid")
    pairs = stays.toPandas().merge(timeline.toPandas().drop(columns="rid"), on="u")
    pairs = pairs[(pairs.ts >= pairs.intime + lo) & (pairs.ts <= pairs.intime + hi)]
    want = pairs.groupby("rid").v.agg(low="min", high="max", n="count")
    pd.testing.assert_frame_equal(got.sort_index(), want, check_dtype=False)


def test_rollup_window_on_a_block_edge(spark):
    day = dt.timedelta(days=1)
    base = dt.datetime(2024, 1, 1)
    facts = spark.createDataFrame([(1, base + k * day / 2, k) for k in range(8)], "u int, ts timestamp_ntz, v int")
    stays = spark.createDataFrame([(7, 1, base + day)], "s int, u int, intime timestamp_ntz")
    got = lookups.rollup_window(facts, stays, "u", "s", "ts", "intime", -day, day, {"n": ("sum", "v")})
    assert [tuple(r) for r in got.collect()] == [(7, 0 + 1 + 2 + 3 + 4)]


def test_nearest_match(scored):
    pairs = [nearest_match(scored, ROLES, "p", **kw) for kw in ({}, {"rows_per_bucket": 25})]
    got = same(*pairs, ["id"])
    pdf = scored.toPandas()
    control = pdf[pdf.t == 0]
    want = [np.abs(control.p - p).min() for p in pdf[pdf.t == 1].sort_values("id").p]
    assert np.allclose(got.distance, want)


@pytest.mark.parametrize("by", [[], ["cohort"]])
def test_auc_and_roc(scored, by):
    areas = [scores.auc(scored, "y", "p", by, **kw) for kw in ({}, {"rows_per_bucket": 30})]
    got = same(*areas, by or ["auc"])
    flipped = scores.auc(scored.withColumn("p", 1 - F.col("p")), "y", "p", by).toPandas()
    if by:
        flipped = flipped.sort_values(by, ignore_index=True)
    assert np.allclose(got.auc, 1 - flipped.auc)
    same(*[scores.roc(scored, "y", "p", by, **kw) for kw in ({}, {"rows_per_bucket": 30})], [*by, "threshold"])


def test_wasserstein(scored):
    costs = [distance.wasserstein_by_feature(scored, ROLES, **kw) for kw in ({}, {"rows_per_bucket": 30})]
    got = [c.toPandas().sort_values("feature", ignore_index=True) for c in costs]
    assert np.allclose(got[0][["w1", "w2_squared"]], got[1][["w1", "w2_squared"]])
    pdf = scored.toPandas()
    u = (np.arange(360 * 540) + 0.5) / (360 * 540)
    for row in got[0].itertuples():
        a, b = (np.sort(pdf[pdf.t == k][row.feature].to_numpy()) for k in (1, 0))
        qa, qb = a[(u * len(a)).astype(int)], b[(u * len(b)).astype(int)]
        assert np.isclose(row.w1, np.abs(qa - qb).mean(), atol=1e-3)
        assert np.isclose(row.w2_squared, ((qa - qb) ** 2).mean(), atol=1e-3)


def test_curve_and_describe(scored):
    same(*[interpretation.ordered_curve(scored, "ite", "id", **kw) for kw in ({}, {"rows_per_bucket": 40})], ["id"])
    grouped = scored.withColumn("grp", interpretation.responder_group("ite"))
    same(*[interpretation.describe_by(grouped, "grp", ["x1", "x2"], **kw) for kw in ({}, {"rows_per_bucket": 10})],
         ["grp", "feature"])


def test_fitted_parameters(scored):
    same(*[scaling.fit_params(scored, ["x1", "x2", "p"], F.col("t") == 1, **kw) for kw in ({}, {"rows_per_bucket": 10})],
         ["feature"])


def test_bootstrap_brackets_the_mean(scored):
    grouped = scored.withColumn("grp", interpretation.responder_group("ite"))
    got = interpretation.bootstrap(grouped, "id", ["x1", "x2"], "grp", 200).toPandas()
    assert ((got.low <= got["mean"]) & (got["mean"] <= got.high)).all() and len(got) == 6
