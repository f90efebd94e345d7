"""Edge semantics on hand-made rows with answers worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mirador.effects import strata
from mirador.effects.matching import nearest_match
from mirador.functions.numeric import clean_number, to_fraction, uniform
from mirador.functions.text import mentions, never_mentions
from mirador.functions.timing import DAY, HOUR, MINUTE, whole_units
from mirador.metrics import distance, interpretation, scores
from mirador.operators import cleaning, codes, dosing, lookups, reshape, summaries, windows
from mirador.prep import ranking, scaling, split
from mirador.roles import Roles
from mirador.sources import tables

T0 = dt.datetime(2024, 1, 1)
MS = dt.timedelta(milliseconds=1)


def values(df, col):
    return [r[col] for r in df.collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def offsets(spark, spans):
    rows = [(i, 1, T0 + s if s is not None else None) for i, s in enumerate(spans)]
    return spark.createDataFrame(rows, "i int, u int, ts timestamp_ntz")


@pytest.fixture(scope="module")
def anchor(spark):
    return spark.createDataFrame([(1, T0)], "u int, anchor_ts timestamp_ntz")


def test_window_closed(spark, anchor):
    df = offsets(spark, [-31 * MINUTE, -30 * MINUTE, 0 * MINUTE, DAY, DAY + MS, None])
    kept = windows.in_window(df, anchor, "u", "ts", "anchor_ts", -30 * MINUTE, DAY)
    assert sorted(values(kept, "i")) == [1, 2, 3]


def test_window_without_lower_bound(spark, anchor):
    df = offsets(spark, [-5 * DAY, 72 * HOUR - MS, 72 * HOUR])
    kept = windows.in_window(df, anchor, "u", "ts", "anchor_ts", None, 72 * HOUR, "left")
    assert sorted(values(kept, "i")) == [0, 1]


def test_whole_hours(spark):
    pairs = [("00:50", "01:10", 0), ("01:20", "03:10", 1), ("03:10", "01:20", -1)]
    for start, end, want in pairs:
        a, b = (F.lit(f"2024-01-01 {x}:00").cast("timestamp_ntz") for x in (start, end))
        assert one(spark, whole_units(b, a)) == want


def test_overlap(spark):
    rows = [(0, -2, -1), (1, -2, 0), (2, 24, 30), (3, 25, 26)]
    df = spark.createDataFrame(rows, "i int, a int, z int")
    kept = df.filter(windows.overlaps(F.col("a"), F.col("z"), F.lit(0), F.lit(24)))
    assert sorted(values(kept, "i")) == [1, 2]


def test_text(spark):
    df = spark.createDataFrame([("Arterieel",), ("ven.",), (None,)], "s string")
    assert values(df.select(mentions("s", "art", null_ok=True).alias("k")), "k") == [True, False, True]
    df = spark.createDataFrame([("Verpleegkundige",), ("Systeem",), (None,)], "s string")
    assert values(df.select(never_mentions("s", "systeem").alias("k")), "k") == [True, False, False]


def test_sentinel_dose(spark):
    df = spark.createDataFrame([("_",), ("___",), ("5",), ("x",), (None,)], "s string")
    assert values(df.select(clean_number("s", ("_", "___")).alias("d")), "d") == [None, None, 5.0, None, None]


def test_equivalent(spark):
    df = spark.createDataFrame([(1, "a", 4.0), (1, "b", 100.0), (1, "c", 32.0)], "u int, s string, dose double")
    got = dosing.equivalent(df, ["u"], "s", F.col("dose"), {"a": 5, "b": 0.2, "c": 1}, F.lit(2.0)).first()
    assert (got["total"], got["per_unit"]) == (72.0, 36.0)


def test_rules(spark):
    rows = [(True, 1.9), (True, 2.0), (True, 8.0), (True, 8.1), (False, 8.1)]
    df = spark.createDataFrame([("k", *r) for r in rows], "item string, ok boolean, v double")
    got = cleaning.apply_rules(df, [cleaning.Rule("k", True, lower=2, upper=8)], "item", "v", "ok")
    assert values(got, "v") == [None, 2.0, 8.0, None, 8.1]
    rows = [(True, 117.0), (False, 117.0), (True, 70.0)]
    df = spark.createDataFrame([("k", *r) for r in rows], "item string, ok boolean, v double")
    got = cleaning.apply_rules(df, [cleaning.Rule("k", True, divide_above=70)], "item", "v", "ok")
    assert values(got, "v") == [11.7, 117.0, 70.0]


def test_percent(spark):
    df = spark.createDataFrame([(v,) for v in (0.4, 1.0, 5.0, 20.0, 100.0, 120.0)], "v double")
    assert values(df.select(to_fraction("v").alias("f")), "f") == [0.4, 1.0, None, 0.2, 1.0, None]


def test_steps(spark):
    steps = [("g", 1, 2, 0.22), ("g", 2, 3, 0.25), ("g", 5, None, 0.35)]
    df = spark.createDataFrame([("g", v) for v in (0.5, 1.0, 2.99, 4.0, 5.0, None)], "g string, v double")
    got = df.select(dosing.step_value("g", "v", steps, 0.21).alias("f"))
    assert values(got, "f") == [0.21, 0.22, 0.25, 0.21, 0.35, 0.21]


def test_normalise(spark):
    df = spark.createDataFrame([(0, 11, 4, 80.0, 80.0), (9, 9, 9, 80.0, 80.0)], "k int, d int, r int, dose double, w double")
    got = dosing.normalise(df, ["k", "d", "r"], [(0, 11, 4, 1.0, True)], "dose", "w")
    assert sorted(values(got, "dose_norm"), key=str) == [1.0, None]


def test_daily(spark):
    spans = [(-MS, 10.0), (0 * MS, 5.0), (DAY - MS, 5.0), (DAY, 7.0)]
    df = spark.createDataFrame([(1, T0 + s, v, T0) for s, v in spans], "u int, ts timestamp_ntz, v double, a timestamp_ntz")
    got = {r["day"]: r["total"] for r in dosing.per_day(df, ["u"], "ts", "v", "a").collect()}
    assert got == {-1: 10.0, 0: 10.0, 1: 7.0}
    df = spark.createDataFrame([(1, T0 + s, 1.0, T0) for s in (0 * DAY, 2 * DAY)], "u int, ts timestamp_ntz, v double, a timestamp_ntz")
    got = {r["day"]: r["total"] for r in dosing.per_day(df, ["u"], "ts", "v", "a", dense=True).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0}


def test_threshold(spark):
    daily = spark.createDataFrame([(1, "k", 199.9), (2, "k", 200.0)], "u int, item string, total double")
    spine = spark.createDataFrame([(1,), (2,), (3,)], "u int")
    got = dosing.threshold_flag(daily, "u", "item", "total", {"k": 200}, spine)
    assert {r["u"]: r["treated"] for r in got.collect()} == {1: 0, 2: 1, 3: 0}


def test_band_and_priority(spark):
    probe = spark.createDataFrame([(1, 1, T0), (2, 2, T0)], "p int, u int, ts timestamp_ntz")
    spans = [-60, -59, 0, 14, 15]
    ref = spark.createDataFrame([(i, 1, T0 + s * MINUTE) for i, s in enumerate(spans)], "r int, u int, rts timestamp_ntz")
    got = lookups.band_pairs(probe, ref, "u", "ts", "rts", HOUR, 15 * MINUTE).collect()
    assert sorted((x["p"], -1 if x["r"] is None else x["r"]) for x in got) == [(1, 1), (1, 2), (1, 3), (2, -1)]
    ref = spark.createDataFrame(
        [(10, 1, T0 - MINUTE, 2), (11, 1, T0 + 5 * MINUTE, 1), (12, 1, T0 - 20 * MINUTE, 1)],
        "r int, u int, rts timestamp_ntz, k int",
    )
    got = lookups.asof_match(probe, ref, "u", "ts", "rts", HOUR, 15 * MINUTE, ["r"], F.col("k"), [1, 2], [F.col("r")])
    assert {x["p"]: x["r"] for x in got.collect()} == {1: 12, 2: None}


def test_onset_takes_the_first_suspicion(spark):
    susp = spark.createDataFrame(
        [(1, T0 + 90 * HOUR, "b"), (1, T0, "a"), (2, T0, "c")], "u int, ts timestamp_ntz, ab string"
    )
    score = spark.createDataFrame([(1, T0 + 24 * HOUR, 3), (1, T0 + 60 * HOUR, 4), (2, T0 + 25 * HOUR, 5)],
                                  "u int, sts timestamp_ntz, s int")
    got = lookups.onset(susp, score, "u", "ts", "sts", 48 * HOUR, 24 * HOUR, ["s"], ["ts", "ab"])
    assert [(r["u"], r["ab"], r["s"]) for r in got.collect()] == [(1, "a", 3)]


def test_all_true_with_null_group(spark):
    rows = [(1, True), (1, True), (2, True), (2, False), (None, False)]
    df = spark.createDataFrame(rows, "u int, k boolean")
    got = {r["u"]: r["flag"] for r in summaries.all_true(df, ["u"], F.col("k")).collect()}
    assert got == {1: 1, 2: 0, None: 0}


def test_horizon(spark):
    rows = [(T0 + 28 * DAY,), (None,), (T0 - DAY,)]
    df = spark.createDataFrame(rows, "d timestamp_ntz").withColumn("a", F.lit(T0).cast("timestamp_ntz"))
    opened = df.select(windows.within_horizon("d", "a", 28 * DAY).alias("y"))
    closed = df.select(windows.within_horizon("d", "a", 28 * DAY, closed=True).alias("y"))
    assert values(opened, "y") == [0, 0, 1] and values(closed, "y") == [1, 0, 1]


def test_scaling(spark):
    rows = [("train", 2.0, 7.0), ("train", 4.0, 7.0), ("train", None, 7.0), ("test", 5.0, 7.0)]
    df = spark.createDataFrame(rows, "split string, a double, b double")
    params = scaling.fit_params(df, ["a", "b"], F.col("split") == "train")
    scaled = scaling.scale(df, params)
    assert values(scaled, "a") == [0.0, 1.0, None, 1.5] and values(scaled, "b") == [0.0] * 4
    assert values(scaling.impute_scaled(scaled, params), "a") == [0.0, 1.0, 0.5, 1.5]
    assert values(scaling.impute(df, params), "a") == [2.0, 4.0, 3.0, 5.0]


def test_full_outer(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "k int, a int")
    b = spark.createDataFrame([(2, 1), (3, 1)], "k int, b int")
    got = lookups.reconcile(a, b, ["k"]).collect()
    assert len(got) == 3 and sum(r["a"] is not None and r["b"] is not None for r in got) == 1


def test_scores(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.6), (0, 0.2)], "y int, p double")
    assert scores.auc(df, "y", "p").first()["auc"] == 0.625
    df = spark.createDataFrame([(1, 0.8), (0, 0.4)], "y int, p double")
    assert scores.brier(df, "y", "p").first()["brier"] == pytest.approx(0.1)
    df = spark.createDataFrame([(1, 0.5)], "y int, p double")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in scores.confusion(df, "y", "p").collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    points = [(0.0, 0), (0.1, 0), (0.10001, 1), (0.3, 2), (0.7, 6), (1.0, 9)]
    df = spark.createDataFrame([(1, p) for p, _ in points], "y int, p double")
    bins = {r["bin"]: r["n"] for r in scores.calibration(df, "y", "p").collect()}
    assert bins == {0: 2, 1: 1, 2: 1, 6: 1, 9: 1}
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "y int, p double")
    assert scores.log_loss(df, "y", "p").first()["log_loss"] == 50.0


def test_auc_without_a_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.8), (1, 0.2)], "y int, p double")
    assert scores.auc(df, "y", "p").first()["auc"] is None


def test_groups(spark):
    df = spark.createDataFrame([(v,) for v in (-0.1, -0.0999, 0.0999, 0.1)], "ite double")
    got = values(df.select(interpretation.responder_group("ite").alias("g")), "g")
    assert got == ["responder", "neutral", "neutral", "harmed"]


ROLES = Roles("id", "t", "y", ("x",))


def test_strata_and_match(spark):
    rows = [(1, 1, 1, "s"), (2, 1, 0, "s"), (3, 0, 1, "s"), (4, 0, 1, "s")]
    df = spark.createDataFrame(rows, "id int, t int, y int, s string")
    assert set(values(strata.stratified(df, ROLES, ["s"]), "ite")) == {-0.5}
    rows = [(1, 1, 0.30), (2, 1, 0.31), (3, 0, 0.29), (4, 0, 0.50)]
    df = spark.createDataFrame(rows, "id int, t int, p double")
    assert values(nearest_match(df, ROLES, "p"), "match_id") == [3, 3]


def test_match_without_controls(spark):
    df = spark.createDataFrame([(1, 1, 0.3)], "id int, t int, p double")
    assert values(nearest_match(df, ROLES, "p"), "match_id") == [None]


def test_wasserstein(spark):
    rows = [(0, 0.0), (0, 1.0), (1, 1.0), (1, 2.0)]
    df = spark.createDataFrame(rows, "t int, x double")
    got = distance.wasserstein_by_feature(df, ROLES).first()
    assert (got["w1"], got["w2_squared"]) == (1.0, 1.0)


def test_hash_split(spark):
    assert one(spark, uniform(F.lit(17), seed=42)) == 0.3849974649492651
    ids = spark.range(500).withColumn("id", F.col("id"))
    got = {r["id"]: r["split"] for r in split.hash_split(ids, "id").collect()}
    again = {r["id"]: r["split"] for r in split.hash_split(ids.repartition(7), "id").collect()}
    assert got == again and got[17] == "train" and 360 < sum(v == "train" for v in got.values()) < 440
    exact = [r["split"] for r in split.exact_split(ids, "id").collect()]
    assert exact.count("train") == 400 and len(exact) == 500


def test_codes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k long, s string")
    assert sorted(values(codes.in_codes(df, "k", [1, 3, 3]), "k")) == [1, 3]
    assert sorted(values(codes.in_codes(df, "k", list(range(2, 600))), "k")) == [2, 3]
    assert sorted(values(codes.in_codes(df, ["k", "s"], [(1, "a"), (2, "a")]), "k")) == [1]
    with pytest.raises(ValueError):
        codes.lookup_table(df, [(1, "x"), (1, "y")], ["k"], "f string")


def test_first_by_puts_nulls_first(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 2, "b"), (2, 3, "c")], "u int, o int, v string")
    assert {r["u"]: r["v"] for r in lookups.first_by(df, ["u"], ["o"]).collect()} == {1: "n", 2: "c"}


def test_assemble_refuses_repeated_ids(spark):
    spine = spark.createDataFrame([(1,)], "u int")
    part = spark.createDataFrame([(1, 2), (1, 3)], "u int, v int")
    with pytest.raises(ValueError):
        lookups.assemble(spine, [part], "u")


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.5), ("d", 0.1)], "feature string, importance double")
    got = {r["feature"]: r["ranking"] for r in ranking.rank_features(df, 3).collect()}
    assert got == {"b": 1.0, "a": 2.5, "c": 2.5}


def test_fill_and_missingness(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = {r["feature"]: r["missing"] for r in summaries.missingness(df, ["a", "b"]).collect()}
    assert got == {"a": 0.5, "b": 1.0}
    assert values(cleaning.fill(df, {"a": 400.0}), "a") == [1.0, 400.0]


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, "a", 2)], "k long, s string, extra int")
    schema = StructType([StructField("s", StringType()), StructField("k", LongType())])
    assert tables.validate_schema(df, schema).columns == ["s", "k"]
    with pytest.raises(ValueError):
        tables.validate_schema(df.drop("s"), schema)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, k int")
    assert values(tables.nan_to_null(df), "a") == [None, 2.0]


def test_csv_keeps_empty_text_and_null(spark, tmp_path):
    df = spark.createDataFrame([(1, "", T0 + MS), (2, None, None), (3, 'a "q", b', T0)], "k int, s string, ts timestamp_ntz")
    tables.write_csv(df, str(tmp_path / "c"))
    got = tables.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_widen_names(spark):
    df = spark.createDataFrame([(1, "f", 1.0, 2.0)], "u int, feature string, median double, max double")
    got = reshape.widen(df, ["u"], "feature", ["f", "g"], ["median", "max"])
    assert got.columns == ["u", "median_f", "max_f", "median_g", "max_g"]
    assert got.first()["median_f"] == 1.0 and got.first()["max_g"] is None


def test_bootstrap_by_hand(spark, monkeypatch):
    """Batches, partitions and groups given out early change nothing; nulls count for no column."""
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), None if i % 5 == 0 else float(rng.normal()), [None, "a", "b"][i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, z double, g string")
    got = {(r.g, r.feature): r for r in interpretation.bootstrap(df.repartition(5), "id", ["x", "z"], "g", 50).collect()}
    weights = interpretation.resample_weights([str(r[0]) for r in rows], 42, 50)
    assert weights.shape == (400, 50) and abs(weights.mean() - 1) < 0.05
    for g in (None, "a", "b"):
        for k, c in ((1, "x"), (2, "z")):
            own = [i for i, r in enumerate(rows) if r[3] == g and r[k] is not None]
            values = np.array([rows[i][k] for i in own])
            means = weights[own].T @ values / weights[own].sum(axis=0)
            assert got[g, c].low == pytest.approx(np.quantile(means, 0.025))
            assert got[g, c].high == pytest.approx(np.quantile(means, 0.975))


def test_distinct_texts_are_bounded(spark):
    rows = [("many", f"v{i:06d}") for i in range(50_000)] + [("few", "b"), ("few", "a"), ("few", "b"), ("few", None), (None, "x")]
    got = {r.k: (r.texts, r.rest) for r in summaries.distinct_texts(spark.createDataFrame(rows, "k string, v string"), ["k"], "v", 3).collect()}
    assert got == {"many": ("v000000; v000001; v000002", 49_997), "few": ("a; b", 0), None: ("x", 0)}


def test_sorted_files(spark, tmp_path):
    """Order across files, with a tie as long as most of the table."""
    rows = [(i, 1.0 if i % 4 else float(i), "x") for i in range(2000)] + [(5000, None, "y")]
    df = spark.createDataFrame(rows, "id int, v double, other string").repartition(6)
    tables.write_sorted(df, str(tmp_path / "s"), [F.desc_nulls_last("v"), F.asc("id")], files=7)
    got = sorted((r.position, r.id) for r in tables.read_positions(spark, str(tmp_path / "s")).collect())
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == [(k, r[0]) for k, r in enumerate(want, 1)]
    sizes = spark.read.parquet(str(tmp_path / "s")).groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 700


def test_bootstrap_leaves_out_small_groups(spark):
    df = spark.createDataFrame([(i, "big" if i < 30 else "small", float(i)) for i in range(32)], "id int, g string, x double")
    got = interpretation.bootstrap(df, "id", ["x"], "g", 50).collect()
    assert [r["g"] for r in got] == ["big"]
