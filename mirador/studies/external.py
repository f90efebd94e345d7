"""External cohort: derived hospital tables with timestamps, keyed by intensive-care stay."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from mirador.functions.numeric import clean_number
from mirador.functions.timing import DAY, HOUR, epoch_micros, whole_units
from mirador.operators import cleaning, codes, dosing, lookups, summaries, windows
from mirador.studies import definitions as d

TICK = dt.timedelta(microseconds=1)


def sepsis_onset(sofa: DataFrame, suspicion: DataFrame, icustay_detail: DataFrame) -> DataFrame:
    """Earliest suspected infection per stay with an organ-failure score of 2 or more in the
    48 hours before to 24 hours after, if it falls less than 24 whole hours into the stay."""
    organs = ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"]
    scored = sofa.filter("sofa_24hours >= 2").select(
        "stay_id", F.col("endtime").alias("sofa_time"), F.col("sofa_24hours").alias("sofa_score"),
        *[F.col(f"{o}_24hours").alias(o) for o in organs],
    )
    asked = suspicion.select(
        "subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time",
        "suspected_infection",
    )
    first = lookups.onset(
        asked, scored, "stay_id", "suspected_infection_time", "sofa_time", 48 * HOUR, 24 * HOUR,
        ["sofa_score", *organs],
        order=["suspected_infection_time", "antibiotic_time", "culture_time"],
    )
    joined = first.join(icustay_detail.select("stay_id", "icu_intime"), "stay_id", "left")
    sepsis3 = (F.col("sofa_score") >= 2) & (F.col("suspected_infection") == 1)
    return joined.filter(whole_units("suspected_infection_time", "icu_intime", "HOUR") < 24).select(
        "subject_id", "stay_id", "antibiotic_time", "culture_time", "suspected_infection_time",
        "sofa_time", "sofa_score", *organs, sepsis3.alias("sepsis3"), "icu_intime",
    )


def mortality(icustay_detail: DataFrame) -> DataFrame:
    """Stays with the 28-day outcome; death on the 28th day counts."""
    died = windows.within_horizon(
        F.col("dod").cast("timestamp_ntz"), F.col("icu_intime").cast("timestamp_ntz"), 28 * DAY, closed=True
    )
    return icustay_detail.select(
        "subject_id", "hadm_id", "stay_id", "gender", "dod", "admission_age", "icu_intime",
        "icu_outtime", died.alias(d.OUTCOME),
    )


def first_day_crp(icustay_detail: DataFrame, inflammation: DataFrame) -> DataFrame:
    """Highest value in the first 24 hours of each stay; values are kept per admission."""
    key = F.struct("subject_id", "hadm_id")
    facts = inflammation.filter("crp IS NOT NULL").select(key.alias("person"), "charttime", "crp")
    stays = icustay_detail.select(key.alias("person"), "stay_id", "icu_intime")
    return lookups.rollup_window(
        facts, stays, "person", "stay_id", "charttime", "icu_intime", dt.timedelta(0), DAY,
        {"crp": ("max", "crp")},
    )


def steroid_totals(emar: DataFrame, emar_detail: DataFrame, icustay_detail: DataFrame) -> DataFrame:
    """Methylprednisolone equivalents given between hour 1 and 71 of a stay, and per day of stay."""
    given = codes.in_codes(emar, "medication", list(d.STEROID_FACTORS))
    given = codes.in_codes(given, "event_txt", d.GIVEN_EVENTS)
    details = emar_detail.filter(~F.col("dose_given").isin(*d.BLANK_DOSES)).select("emar_id", "dose_given")
    stays = icustay_detail.select("hadm_id", "stay_id", "icu_intime", "icu_outtime", "los_icu")
    joined = given.select("hadm_id", "emar_id", "medication", "charttime").join(details, "emar_id").join(
        stays, "hadm_id"
    )
    inside = joined.filter(
        (whole_units("icu_outtime", "charttime", "HOUR") > 0)
        & whole_units("charttime", "icu_intime", "HOUR").between(1, 71)
    )
    totals = dosing.equivalent(
        inside, ["stay_id"], "medication", clean_number("dose_given", d.BLANK_DOSES),
        d.STEROID_FACTORS, F.col("los_icu"),
    )
    return totals.select(
        "stay_id", F.col("total").alias("methylprednisolone_equivalent_total"),
        F.col("per_unit").alias("methylprednisolone_equivalent_normalized_by_icu_los"),
    )


def high_dose_steroids(totals: DataFrame) -> DataFrame:
    high = F.coalesce(F.col("methylprednisolone_equivalent_total") >= d.EXTERNAL_STEROID_LIMIT, F.lit(False))
    return totals.select("stay_id", high.cast("int").alias(d.TREATMENT))


def max_gamma(first_day_bg: DataFrame, doses: DataFrame) -> DataFrame:
    """Highest vasopressor dose whose interval ends within 24 whole hours of the first start."""
    known = doses.join(first_day_bg.select("stay_id").distinct(), "stay_id", "left_semi")
    return summaries.peak_within(
        known, "stay_id", "starttime", "endtime", "norepinephrine_equivalent_dose", 24,
        "max_gamma_vasopressor",
    )


def blood_gas(bg: DataFrame, icustays: DataFrame) -> DataFrame:
    """Blood gases of the person from 24 whole hours before to 8 after the stay begins.

    Whole hours are cut toward zero, so the exact window is 25 and 9 hours, both open.
    """
    facts = bg.select("subject_id", "charttime", "pao2fio2ratio", "lactate", "ph",
                      epoch_micros("charttime").alias("at"))
    rolled = lookups.rollup_window(
        facts, icustays.select("subject_id", "stay_id", "intime"), "subject_id", "stay_id",
        "charttime", "intime", -25 * HOUR + TICK, 9 * HOUR - TICK,
        {
            "min_pf_ratio": ("min", "pao2fio2ratio"), "max_lactate": ("max", "lactate"),
            "min_ph": ("min", "ph"), "_first": ("min", "at"), "rows_per_hadm": ("count", "charttime"),
        },
    )
    joined = rolled.join(icustays.select("stay_id", epoch_micros("intime").alias("_in")), "stay_id")
    hours = ((F.col("_in") - F.col("_first")) / 3.6e9).cast("long")
    return joined.select(
        "stay_id", "min_pf_ratio", "max_lactate", "min_ph", hours.alias("time_diff"), "rows_per_hadm"
    )


def first_day_features(first_day_lab: DataFrame, first_day_vitalsign: DataFrame) -> DataFrame:
    labs = first_day_lab.select(
        "stay_id", F.col("sodium_max").alias("max_sodium"), F.col("potassium_max").alias("max_potassium"),
        F.col("glucose_max").alias("max_glucose"), F.col("bicarbonate_min").alias("min_bicarbonate"),
        F.col("bun_max").alias("max_bun"), F.col("creatinine_max").alias("max_creatinine"),
        F.col("abs_lymphocytes_max").alias("max_lymphocytes"),
        F.col("abs_lymphocytes_min").alias("min_lymphocytes"), F.col("wbc_max").alias("max_wbc"),
    )
    vitals = first_day_vitalsign.select(
        "stay_id", F.col("heart_rate_mean").alias("mean_heart_rate"),
        F.col("temperature_max").alias("max_temperature"),
    )
    return lookups.assemble(labs, [vitals], "stay_id")


def demographics(
    first_day_bg: DataFrame, first_day_weight: DataFrame, first_day_height: DataFrame,
    icustay_detail: DataFrame,
) -> DataFrame:
    spine = first_day_bg.select("stay_id").distinct()
    detail = icustay_detail.select("stay_id", "gender", F.col("admission_age").alias("age"))
    return lookups.assemble(
        spine,
        [first_day_weight.select("stay_id", "weight"), first_day_height.select("stay_id", "height"), detail],
        "stay_id",
    )


def ventilation(statuses: DataFrame, first_day_bg: DataFrame) -> DataFrame:
    """1 when every ventilation status of the stay is a ventilated one.

    Statuses of stays outside the blood-gas table end in a group without stay id.
    """
    stays = first_day_bg.select("stay_id", F.col("stay_id").alias("bg_stay")).distinct()
    held = statuses.groupBy("stay_id").agg(
        F.bool_and(F.coalesce(F.col("ventilation_status").isin(*d.VENTILATED), F.lit(False))).alias("held")
    )
    joined = held.join(stays, "stay_id", "full").drop("stay_id").withColumnRenamed("bg_stay", "stay_id")
    return summaries.all_true(joined, ["stay_id"], F.col("held"), "ventilation")


def analysis_table(
    sepsis: DataFrame, mortality: DataFrame, demographics: DataFrame, blood_gas: DataFrame,
    features: DataFrame, gamma: DataFrame, ventilation: DataFrame, crp: DataFrame, steroids: DataFrame,
) -> DataFrame:
    """The external cohort in the units and column names of the internal analysis table."""
    parts = [
        mortality.select("stay_id", "gender", d.OUTCOME), demographics.select("stay_id", "age", "weight", "height"),
        blood_gas.select("stay_id", "min_pf_ratio", "max_lactate", "min_ph"), features, gamma,
        ventilation.filter("stay_id IS NOT NULL"), crp, high_dose_steroids(steroids),
    ]
    table = lookups.assemble(sepsis.select("stay_id"), parts, "stay_id", check_unique=False)
    table = cleaning.convert(table, d.EXTERNAL_UNITS)
    table = cleaning.fill(table, {
        d.TREATMENT: 0, "min_pf_ratio": float(d.NORMAL_PF_RATIO), "max_gamma_vasopressor": 0.0,
    })
    return cleaning.harmonise(
        table, d.EXTERNAL_NAMES, d.ANALYSIS_COLUMNS, {"gender": cleaning.recode("gender", {"F": 0, "M": 1})}
    )
