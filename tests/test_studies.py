"""The two clinical cohorts on a few hand-made rows."""

import datetime as dt

import pytest

from mirador.roles import Roles
from mirador.studies import definitions as d
from mirador.studies import external, internal

MIN, HOUR = 60_000, 3_600_000
T0 = dt.datetime(2150, 1, 1, 8)


def h(n):
    return T0 + dt.timedelta(hours=n)


def col(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def src(spark):
    """Two admissions; the second starts at 1,000,000 ms."""
    start = {1: 0, 2: 1_000_000}

    def items(rows):
        return spark.createDataFrame(
            [(a, i, v, start[a] + ms, u, by) for a, i, v, ms, u, by in rows],
            "admissionid long, itemid long, value double, measuredat long, unitid long, registeredby string",
        )

    numeric = items([
        (1, 6840, 140.0, HOUR, 1, "Systeem"), (1, 9555, 150.0, 2 * HOUR, 1, "x"),
        (1, 6840, 90.0, 3 * HOUR, 1, "x"),  # validated and out of range
        (1, 6640, 80.0, -30 * MIN, 1, "x"), (1, 6640, 100.0, 24 * HOUR, 1, "x"),
        (1, 6640, 500.0, 24 * HOUR + 1, 1, "x"),  # out of the window
        (1, 6779, 117.0, HOUR, 1, "x"),  # separator lost
        (1, 9996, 90.0, 10 * HOUR, 173, "Verpleegkundige"),
        (1, 21214, 12.0, 10 * HOUR, 152, "Systeem"),  # same time, original unit: preferred
        (1, 7433, 70.0, 15 * HOUR, 173, "x"),  # venous specimen
        (1, 12279, 40.0, 10 * HOUR - 50 * MIN, 1, "x"), (1, 12279, 60.0, 10 * HOUR + 5 * MIN, 1, "x"),
        (1, 8845, 3.0, 10 * HOUR - MIN, 1, "x"),
        (1, 6848, 7.2, HOUR, 1, "Verpleegkundige"), (1, 6848, 6.5, 2 * HOUR, 1, "Verpleegkundige"),
        (2, 9996, 80.0, 5 * HOUR, 173, "x"), (2, 8845, 3.5, 5 * HOUR - 30 * MIN, 1, "x"),
    ])
    unvalidated = items([(1, 6835, 2.2, HOUR, 1, None), (1, 6835, 9.0, HOUR, 1, None)])
    admissions = spark.createDataFrame(
        [(1, 0, "60-69"), (2, 1_000_000, None)], "admissionid long, admittedat long, weightgroup string"
    )
    listitems = spark.createDataFrame(
        [(1, 9534, 2, "IPPV", HOUR), (1, 9534, 2, "IPPV", 2 * HOUR), (1, 9534, 8, "CPAP", HOUR),
         (1, 9534, 8, "CPAP", 24 * HOUR), (2, 12290, 1, "Stand By", 1_000_000 + HOUR),
         (2, 8189, 2, "Nasaal", 1_000_000 + 5 * HOUR - 30 * MIN)],
        "admissionid long, itemid long, valueid long, value string, measuredat long",
    )
    freetext = spark.createDataFrame(
        [(1, 11646, "Arterieel", 10 * HOUR), (1, 11646, "veneus", 15 * HOUR)],
        "admissionid long, itemid long, value string, measuredat long",
    )
    drug = "admissionid long, itemid long, item string, dose double, administered double, " \
           "administeredunit string, duration double, rate double, rateunit string, ordercategoryid long, " \
           "doserateperkg long, doseunitid long, doserateunitid long, start long, stop long"
    drugs = spark.createDataFrame([
        (1, 7106, "hydro", 100.0, 100.0, "mg", 1.0, None, None, 1, None, None, None, HOUR, 2 * HOUR),
        (1, 7106, "hydro", 100.0, 100.0, "mg", 1.0, None, None, 1, None, None, None, 20 * HOUR, 21 * HOUR),
        (2, 7106, "hydro", 150.0, 150.0, "mg", 1.0, None, None, 1, None, None, None, 1_000_000 + HOUR, 1_000_000 + 2 * HOUR),
        (2, 7106, "hydro", 150.0, 150.0, "mg", 1.0, None, None, 1, None, None, None, 1_000_000 + 72 * HOUR, 1_000_000 + 73 * HOUR),
        (1, 7229, "norepi", 0.65, 1.0, "mg", 1.0, 1.0, "ml", 65, 0, 10, 4, -HOUR, HOUR),
        (1, 7229, "norepi", 6.5, 1.0, "mg", 1.0, 0.1, "ml", 65, 0, 10, 4, -HOUR, HOUR),  # rate too low
        (1, 7229, "norepi", 65.0, 1.0, "mg", 1.0, 1.0, "ml", 65, 0, 10, 4, 25 * HOUR, 26 * HOUR),  # too late
        (2, 7229, "norepi", 0.6, 1.0, "mg", 1.0, 1.0, "ml", 65, 1, 11, 5, 1_000_000, 1_000_000 + HOUR),
    ], drug)
    return dict(numericitems=numeric, unvalidated=unvalidated, admissions=admissions,
                listitems=listitems, freetextitems=freetext, drugitems=drugs)


def test_steroids(src):
    records = internal.steroid_records(src["drugitems"], src["admissions"])
    assert records.count() == 3
    assert col(internal.high_dose_steroids(records, src["admissions"]), "admissionid", d.TREATMENT) == {1: 1, 2: 0}


def test_ventilation(src):
    got = internal.mechanical_ventilation(src["listitems"], src["admissions"])
    assert [tuple(r) for r in got.collect()] == [(1, True, "CPAP; IPPV")]


def test_features(src):
    measured = internal.measurements(src["numericitems"], src["unvalidated"], src["admissions"])
    got = internal.feature_columns(measured).collect()
    assert len(got) == 1
    row = got[0].asDict()
    assert (row["max_sodium"], row["median_heartfrequency"], row["max_leucocytes"], row["max_potassium"]) == (150.0, 90.0, 11.7, 9.0)
    assert row["max_bun"] is None


def test_vasopressors(src):
    got = internal.vasopressors(src["drugitems"], src["admissions"])
    gammas = col(got, "admissionid", "gamma")
    assert gammas[1] == pytest.approx(0.65 * 1000 / 65) and gammas[2] == pytest.approx(0.01)


def test_oxygenation(src):
    got = internal.oxygenation(
        src["numericitems"], src["unvalidated"], src["listitems"], src["freetextitems"], src["admissions"]
    )
    rows = {r["admissionid"]: r for r in got.collect()}
    assert got.count() == 2  # the venous sample is out
    first = rows[1]
    assert first["pao2"] == 90.0 and first["fio2"] == 40.0 and first["ventilatory_support"]
    assert first["fio2_time_difference"] == -50.0 and not first["manual_entry"]
    assert rows[2]["fio2"] == 0.27 and not rows[2]["ventilatory_support"]
    worst = col(internal.worst_pf_ratio(got), "admissionid", "pf_ratio")
    assert worst[1] == pytest.approx(225.0) and worst[2] == pytest.approx(80 / 0.27)


def test_ph(src):
    ph = internal.arterial_ph(src["numericitems"], src["unvalidated"], src["freetextitems"], src["admissions"])
    assert col(internal.worst_ph(ph), "admissionid", "arterial_ph") == {1: 7.2}


def test_internal_table(spark, src):
    cohort = spark.createDataFrame([
        (1, "Man", "60-69", 0, 1, 28 * 24 * HOUR - 1, "60-69", "170-179"),
        (2, "Vrouw", "80+", 1_000_000, 1, 1_000_000 + 28 * 24 * HOUR, None, "190+"),
        (3, None, "80+", 0, 1, None, None, None),
    ], "admissionid long, gender string, agegroup string, admittedat long, dischargedat long, "
       "dateofdeath long, weightgroup string, heightgroup string")
    table = internal.analysis_table(cohort, **src)
    assert table.columns == d.ANALYSIS_COLUMNS
    rows = {r["admissionid"]: r for r in table.collect()}
    assert set(rows) == {1, 2}
    assert (rows[1]["gender"], rows[1][d.OUTCOME], rows[1][d.TREATMENT]) == (1, 1, 1)
    assert (rows[2]["gender"], rows[2][d.OUTCOME], rows[2]["estimated_weight"]) == (0, 0, None)
    assert rows[2]["mechanical_ventilation_bool"] == 0 and rows[1]["mechanical_ventilation_bool"] == 1
    roles = Roles.infer(table, d.ID, d.TREATMENT, d.OUTCOME)
    assert len(roles.x) == 19


@pytest.fixture(scope="module")
def ext(spark):
    detail = spark.createDataFrame(
        [(10, 100, 1, "F", dt.date(2150, 1, 29), 70.0, T0, h(96), 4.0),
         (20, 200, 2, "M", None, 50.0, T0, h(48), 2.0)],
        "subject_id long, hadm_id long, stay_id long, gender string, dod date, admission_age double, "
        "icu_intime timestamp_ntz, icu_outtime timestamp_ntz, los_icu double",
    )
    return detail


def test_sepsis(spark, ext):
    organs = ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"]
    fields = "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, sofa_24hours int, " + ", ".join(
        f"{o}_24hours int" for o in organs)
    sofa = spark.createDataFrame(
        [(1, h(0), h(1), 1, *[0] * 6), (1, h(1), h(2), 3, *[1] * 6), (1, h(2), h(3), 4, *[1] * 6),
         (2, h(80), h(90), 4, *[1] * 6)], fields)
    susp = spark.createDataFrame(
        [(10, 1, 1, h(6), h(6), h(5), 1), (10, 1, 2, None, h(5), h(5), 1), (20, 2, 3, h(5), h(5), h(5), 1),
         (30, None, 4, h(5), h(5), h(5), 1)],
        "subject_id long, stay_id long, ab_id long, antibiotic_time timestamp_ntz, "
        "culture_time timestamp_ntz, suspected_infection_time timestamp_ntz, suspected_infection int")
    got = external.sepsis_onset(sofa, susp, ext).collect()
    assert len(got) == 1
    assert got[0]["antibiotic_time"] is None and got[0]["sofa_time"] == h(2) and got[0]["sepsis3"]


def test_mortality(ext):
    assert col(external.mortality(ext), "stay_id", d.OUTCOME) == {1: 1, 2: 0}


def test_crp(spark, ext):
    rows = [(10, 100, h(-1), 99.0), (10, 100, h(0), 5.0), (10, 100, h(24), 7.0), (10, 100, h(25), 50.0)]
    crp = spark.createDataFrame(rows, "subject_id long, hadm_id long, charttime timestamp_ntz, crp double")
    assert col(external.first_day_crp(ext, crp), "stay_id", "crp") == {1: 7.0}


def test_external_steroids(spark, ext):
    emar = spark.createDataFrame(
        [(10, 100, "a", "Dexamethasone", "Administered", h(2)), (10, 100, "b", "Hydrocortisone", "Administered", h(71)),
         (10, 100, "c", "Prednisone", "Not Given", h(3)), (10, 100, "d", "Prednisone", "Started", h(0.5)),
         (10, 100, "e", "Prednisone", "Started", h(72)), (20, 200, "f", "Methylprednisolone", "Confirmed", h(5))],
        "subject_id long, hadm_id long, emar_id string, medication string, event_txt string, charttime timestamp_ntz")
    detail = spark.createDataFrame(
        [("a", "20"), ("a", "_"), ("b", "100"), ("c", "9"), ("d", "9"), ("e", "9"), ("f", "___"), ("f", "32")],
        "emar_id string, dose_given string")
    totals = external.steroid_totals(emar, detail, ext)
    assert col(totals, "stay_id", "methylprednisolone_equivalent_total") == {1: 120.0, 2: 32.0}
    assert col(totals, "stay_id", "methylprednisolone_equivalent_normalized_by_icu_los") == {1: 30.0, 2: 16.0}
    assert col(external.high_dose_steroids(totals), "stay_id", d.TREATMENT) == {1: 1, 2: 0}


def test_gamma_gas_and_ventilation(spark):
    bg_stays = spark.createDataFrame([(1,), (2,)], "stay_id long")
    doses = spark.createDataFrame(
        [(1, h(0), h(2), 0.1), (1, h(5), h(24.5), 0.3), (1, h(20), h(25.5), 0.9), (9, h(0), h(1), 5.0)],
        "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, norepinephrine_equivalent_dose double")
    assert col(external.max_gamma(bg_stays, doses), "stay_id", "max_gamma_vasopressor") == {1: 0.3}

    gas = spark.createDataFrame(
        [(10, h(-25), 100.0, 1.0, 7.1), (10, h(-24.9), 200.0, 2.0, 7.3), (10, h(8.9), 300.0, None, 7.2),
         (10, h(9), 50.0, 9.0, 6.9)],
        "subject_id long, charttime timestamp_ntz, pao2fio2ratio double, lactate double, ph double")
    stays = spark.createDataFrame([(1, 10, T0), (2, 20, T0)], "stay_id long, subject_id long, intime timestamp_ntz")
    got = external.blood_gas(gas, stays).collect()
    assert [tuple(r) for r in got] == [(1, 200.0, 2.0, 7.2, 24, 2)]

    statuses = spark.createDataFrame(
        [(1, "InvasiveVent"), (1, "NonInvasiveVent"), (3, "Tracheostomy")], "stay_id long, ventilation_status string")
    assert col(external.ventilation(statuses, bg_stays), "stay_id", "ventilation") == {1: 1, 2: 0, None: 0}


def test_external_table(spark, ext):
    sepsis = spark.createDataFrame([(1,), (2,)], "stay_id long")
    labs = spark.createDataFrame(
        [(1, 140.0, 4.0, 100.0, 20.0, 10.0, 1.0, 2.0, 1.0, 9.0)],
        "stay_id long, sodium_max double, potassium_max double, glucose_max double, bicarbonate_min double, "
        "bun_max double, creatinine_max double, abs_lymphocytes_max double, abs_lymphocytes_min double, wbc_max double")
    vitals = spark.createDataFrame([(1, 88.0, 38.5)], "stay_id long, heart_rate_mean double, temperature_max double")
    bg = spark.createDataFrame([(1,), (2,)], "stay_id long")
    size = spark.createDataFrame([(1, 70.0)], "stay_id long, weight double")
    tall = spark.createDataFrame([(1, 170.0)], "stay_id long, height double")
    gas = spark.createDataFrame([(1, 210.0, 3.0, 7.3)], "stay_id long, min_pf_ratio double, max_lactate double, min_ph double")
    gamma = spark.createDataFrame([(1, 0.2)], "stay_id long, max_gamma_vasopressor double")
    vent = spark.createDataFrame([(1, 1), (2, 0), (None, 0)], "stay_id long, ventilation int")
    crp = spark.createDataFrame([(1, 7.0)], "stay_id long, crp double")
    steroids = spark.createDataFrame([(1, 120.0)], "stay_id long, methylprednisolone_equivalent_total double")
    table = external.analysis_table(
        sepsis, external.mortality(ext), external.demographics(bg, size, tall, ext), gas,
        external.first_day_features(labs, vitals), gamma, vent, crp, steroids)
    assert table.columns == d.ANALYSIS_COLUMNS
    rows = {r["admissionid"]: r for r in table.collect()}
    assert rows[1]["max_bun"] == pytest.approx(3.57) and rows[1]["max_creatinin"] == pytest.approx(88.4)
    assert (rows[1]["gender"], rows[1][d.TREATMENT], rows[2][d.TREATMENT]) == (0, 1, 0)
    assert (rows[2]["pf_ratio"], rows[2]["max_gamma"], rows[2]["gender"]) == (400.0, 0.0, 1)


def test_code_lists_are_whole():
    assert sum(len(c) for c in d.FEATURE_ITEMS.values()) == 42 and len(d.FEATURE_PICKS) == 11
    assert len(d.STEROID_FACTORS) == 18 and len(d.GIVEN_EVENTS) == 9
