"""Internal cohort: long tables with times in epoch milliseconds, keyed by admission."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from mirador.functions.numeric import to_fraction
from mirador.functions.text import mentions, never_mentions
from mirador.functions.timing import DAY, HOUR, MINUTE, between, from_epoch_millis, minutes
from mirador.operators import cleaning, codes, dosing, lookups, reshape, summaries
from mirador.studies import definitions as d

NOW = dt.timedelta(0)


def _since_admission(ts: str) -> Column:
    """Microseconds since admission, from epoch milliseconds."""
    return (F.col(ts) - F.col("admittedat")) * 1000


def _in_stay(df: DataFrame, admissions: DataFrame, ts: str, lo, hi, closed: str = "both") -> DataFrame:
    joined = df.join(admissions.select("admissionid", "admittedat"), "admissionid")
    return joined.filter(between(_since_admission(ts), lo, hi, closed))


def _both_feeds(numericitems: DataFrame, unvalidated: DataFrame) -> DataFrame:
    cols = ["admissionid", "itemid", "value", "measuredat", "unitid", "registeredby"]
    return numericitems.select(*cols).unionByName(unvalidated.select(*cols))


def steroid_records(drugitems: DataFrame, admissions: DataFrame) -> DataFrame:
    """Steroid doses started less than 72 hours after admission, times as offsets in ms."""
    given = codes.in_codes(drugitems, "itemid", list(d.STEROID_DAILY_LIMIT))
    kept = _in_stay(given, admissions, "start", None, 72 * HOUR, "left")
    return kept.select(
        "admissionid", "itemid", "item", "dose", "administered", "administeredunit", "duration",
        (F.col("start") - F.col("admittedat")).alias("starttime"),
        (F.col("stop") - F.col("admittedat")).alias("stoptime"),
    )


def high_dose_steroids(steroids: DataFrame, admissions: DataFrame) -> DataFrame:
    """1 for admissions with some day (from admission) at or over the drug's limit."""
    timed = steroids.withColumn("start_ts", from_epoch_millis("starttime"))
    daily = dosing.per_day(timed, ["admissionid", "itemid"], "start_ts", "administered")
    return dosing.threshold_flag(
        daily, "admissionid", "itemid", "total", d.STEROID_DAILY_LIMIT, admissions, "high_dose_steroids"
    )


def mechanical_ventilation(listitems: DataFrame, admissions: DataFrame) -> DataFrame:
    """Admissions with a ventilation mode registered in the first 24 hours, and which modes."""
    pairs = [(item, mode) for item, modes in d.VENTILATION_MODES.items() for mode in modes]
    kept = codes.in_codes(listitems, ["itemid", "valueid"], pairs)
    kept = _in_stay(kept, admissions, "measuredat", None, DAY, "left")
    return summaries.presence(kept, ["admissionid"], "value").select(
        "admissionid", F.col("present").alias("mechanical_ventilation_bool"),
        F.col("modes").alias("mechanical_ventilation_modes"),
    )


def measurements(numericitems: DataFrame, unvalidated: DataFrame, admissions: DataFrame) -> DataFrame:
    """Feature measurements of both feeds, from 30 minutes before admission to 24 hours after."""
    items = [code for group in d.FEATURE_ITEMS.values() for code in group]
    both = codes.in_codes(_both_feeds(numericitems, unvalidated), "itemid", items)
    kept = _in_stay(both, admissions, "measuredat", -30 * MINUTE, DAY)
    return kept.select(
        "admissionid", "itemid", "value", "measuredat", "registeredby",
        F.col("registeredby").isNotNull().alias("validated"),
    )


def feature_columns(measured: DataFrame) -> DataFrame:
    """Cleaned measurements as the chosen statistics, one row per admission."""
    named = reshape.map_items(measured, "itemid", d.FEATURE_ITEMS)
    clean = cleaning.require(
        cleaning.apply_rules(named, d.FEATURE_RULES, "feature", "value", "validated"), ["value"]
    )
    stats = summaries.item_stats(clean, ["admissionid", "feature"], "value")
    return reshape.pick_wide(stats, ["admissionid"], "feature", d.FEATURE_PICKS)


def vasopressors(drugitems: DataFrame, admissions: DataFrame) -> DataFrame:
    """Pump intervals touching the first 24 hours with their dose in µg/kg/min (gamma)."""
    given = codes.in_codes(drugitems, "itemid", d.VASOPRESSOR_ITEMS).filter(
        (F.col("ordercategoryid") == d.PUMP_CATEGORY) & (F.col("rate") > d.VASOPRESSOR_MIN_RATE)
    )
    joined = given.join(admissions.select("admissionid", "admittedat", "weightgroup"), "admissionid")
    start, stop = _since_admission("start") / 6e7, _since_admission("stop") / 6e7
    joined = joined.withColumns({
        "start_time": start, "stop_time": stop,
        "patientweight": cleaning.recode("weightgroup", d.WEIGHT_MIDPOINT, F.lit(d.DEFAULT_WEIGHT)),
    }).filter((F.col("start_time") <= 24 * 60) & (F.col("stop_time") >= 0))
    dosed = dosing.normalise(
        joined, ["doserateperkg", "doseunitid", "doserateunitid"], d.GAMMA_FACTORS, "dose",
        "patientweight", "gamma",
    )
    return dosed.select(
        "admissionid", "itemid", "item", "duration", "rate", "rateunit", "start_time", "stop_time", "gamma"
    )


def _specimen(freetextitems: DataFrame) -> DataFrame:
    """One specimen text per admission and time, arterial ones first."""
    texts = freetextitems.filter(F.col("itemid") == d.SPECIMEN_ITEM).select(
        "admissionid", "measuredat", F.col("value").alias("specimen_source"),
        F.lit(True).alias("has_specimen"),
    )
    order = F.when(mentions("specimen_source", "art"), 1).when(F.col("specimen_source").isNull(), 2)
    return lookups.first_by(
        texts, ["admissionid", "measuredat"], [F.coalesce(order, F.lit(3)), "specimen_source"]
    )


def _arterial(df: DataFrame, freetextitems: DataFrame) -> DataFrame:
    """Rows whose specimen is arterial or not known."""
    joined = lookups.lookup_at(df, _specimen(freetextitems), ["admissionid", "measuredat"])
    return joined.filter(mentions("specimen_source", "art", null_ok=True)).drop("has_specimen")


def _manual() -> Column:
    return never_mentions("registeredby", "systeem").alias("manual_entry")


def _preference(items: list[int]) -> Column:
    return cleaning.recode("itemid", {item: i + 1 for i, item in enumerate(items)})


def inspired_oxygen(
    numericitems: DataFrame, unvalidated: DataFrame, listitems: DataFrame, admissions: DataFrame
) -> DataFrame:
    """Oxygen fraction as set on a ventilator, or estimated from device and flow."""
    items = [*d.FIO2_SETTING_ITEMS, *d.OXYGEN_FLOW_ITEMS]
    both = codes.in_codes(_both_feeds(numericitems, unvalidated), "itemid", items).filter("value > 0")
    kept = _in_stay(both, admissions, "measuredat", NOW, DAY)
    device = {code: group for group, members in d.DEVICE_GROUPS.items() for code in members}
    devices = listitems.filter(F.col("itemid") == d.OXYGEN_DEVICE_ITEM).select(
        "admissionid", "measuredat", cleaning.recode("valueid", device).alias("device")
    ).distinct()
    joined = lookups.lookup_at(kept, devices, ["admissionid", "measuredat"])
    support = F.col("itemid").isin(*d.FIO2_SETTING_ITEMS)
    estimate = dosing.step_value("device", "value", d.FLOW_STEPS, d.ROOM_AIR)
    return joined.select(
        "admissionid", F.col("itemid").alias("fio2_item"),
        from_epoch_millis("measuredat").alias("fio2_ts"),
        support.alias("ventilatory_support"),
        F.when(support, F.col("value")).otherwise(estimate).alias("fio2"),
    )


def oxygenation(
    numericitems: DataFrame, unvalidated: DataFrame, listitems: DataFrame,
    freetextitems: DataFrame, admissions: DataFrame,
) -> DataFrame:
    """Each arterial oxygen value with the preferred oxygen fraction around it.

    The fraction is sought from 60 minutes before to 15 after, by item preference, before
    rather than after, nearest, highest; one row per admission and time.
    """
    both = _both_feeds(numericitems, unvalidated)
    pao2 = _in_stay(codes.in_codes(both, "itemid", d.PAO2_ITEMS), admissions, "measuredat", -30 * MINUTE, DAY)
    pao2 = _arterial(pao2, freetextitems).select(
        "admissionid", from_epoch_millis("measuredat").alias("ts"),
        cleaning.convert_coded("value", "unitid", {d.KPA_UNIT: d.KPA_TO_MMHG}, 1).alias("pao2"),
        "specimen_source", _manual(), (_since_admission("measuredat") / 6e7).alias("time"),
        _preference(d.PAO2_ITEMS).alias("item_rank"),
        F.when(mentions("specimen_source", "art"), 1).otherwise(2).alias("specimen_rank"),
    )
    # Of several values at one time, the best unit and specimen: the fraction is the same for all.
    pao2 = lookups.first_by(
        pao2, ["admissionid", "ts"], ["item_rank", "specimen_rank", F.col("pao2").isNull(), -F.col("pao2"), "manual_entry"]
    )
    ranks = {item: i + 1 for i, item in enumerate([*d.FIO2_SETTING_ITEMS, *d.OXYGEN_FLOW_ITEMS])}
    found = lookups.asof_match(
        pao2, inspired_oxygen(numericitems, unvalidated, listitems, admissions),
        "admissionid", "ts", "fio2_ts", HOUR, 15 * MINUTE,
        ["fio2", "ventilatory_support", "fio2_ts"],
        kind=cleaning.recode("fio2_item", ranks), kinds=sorted(ranks.values()),
        tie=[-F.col("fio2")],
    )
    return found.select(
        "admissionid", "pao2", "specimen_source", "manual_entry", "time", "fio2",
        "ventilatory_support", minutes("fio2_ts", "ts").alias("fio2_time_difference"),
    )


def worst_pf_ratio(oxygen: DataFrame) -> DataFrame:
    """Lowest ratio of arterial oxygen to inspired fraction, after cleaning both."""
    clean = oxygen.withColumn("fio2", to_fraction("fio2")).filter(F.col("pao2") >= d.MIN_PAO2)
    return summaries.worst_ratio(clean, ["admissionid"], "pao2", "fio2", "pf_ratio")


def arterial_ph(
    numericitems: DataFrame, unvalidated: DataFrame, freetextitems: DataFrame, admissions: DataFrame
) -> DataFrame:
    both = codes.in_codes(_both_feeds(numericitems, unvalidated), "itemid", d.PH_ITEMS)
    kept = _in_stay(both, admissions, "measuredat", -30 * MINUTE, DAY)
    return _arterial(kept, freetextitems).select(
        "admissionid", "itemid", "value", "specimen_source", "registeredby", _manual(),
        (_since_admission("measuredat") / 6e7).alias("time"),
    )


def worst_ph(ph: DataFrame) -> DataFrame:
    low, high = d.PH_RANGE
    wrong = F.col("manual_entry") & ((F.col("value") < low) | (F.col("value") > high))
    return ph.filter(~F.coalesce(wrong, F.lit(False))).groupBy("admissionid").agg(
        F.min("value").alias("arterial_ph")
    )


def inclusions(cohort: DataFrame) -> DataFrame:
    """Demographics and 28-day outcome of the included admissions, one row each."""
    cols = ["admissionid", "gender", "agegroup", "admittedat", "dateofdeath", "weightgroup", "heightgroup"]
    kept = cleaning.require(cohort.select(*cols), ["gender"], {"gender": list(d.GENDER)})
    died = F.coalesce((F.col("dateofdeath") - F.col("admittedat")) < 28 * 24 * 3600 * 1000, F.lit(False))
    table = kept.select(
        "admissionid", cleaning.recode("gender", d.GENDER).alias("gender"),
        cleaning.recode("agegroup", d.AGE_MIDPOINT).cast("double").alias("estimated_age"),
        cleaning.recode("weightgroup", d.WEIGHT_MIDPOINT).cast("double").alias("estimated_weight"),
        cleaning.recode("heightgroup", d.HEIGHT_MIDPOINT).cast("double").alias("estimated_height"),
        died.cast("int").alias(d.OUTCOME),
    )
    return lookups.first_by(table, ["admissionid"], [d.OUTCOME])


def analysis_table(
    cohort: DataFrame, admissions: DataFrame, drugitems: DataFrame, numericitems: DataFrame,
    unvalidated: DataFrame, listitems: DataFrame, freetextitems: DataFrame,
) -> DataFrame:
    """One row per included admission: covariates, treatment and outcome.

    Missing demographics stay missing here; they are imputed from training rows later.
    """
    vaso = vasopressors(drugitems, admissions).groupBy("admissionid").agg(F.max("gamma").alias("max_gamma"))
    oxygen = oxygenation(numericitems, unvalidated, listitems, freetextitems, admissions)
    parts = [
        high_dose_steroids(steroid_records(drugitems, admissions), admissions),
        mechanical_ventilation(listitems, admissions).select("admissionid", "mechanical_ventilation_bool"),
        worst_pf_ratio(oxygen), vaso,
        worst_ph(arterial_ph(numericitems, unvalidated, freetextitems, admissions)),
        feature_columns(measurements(numericitems, unvalidated, admissions)),
    ]
    table = lookups.assemble(inclusions(cohort), parts, "admissionid", check_unique=False)
    filled = cleaning.fill(table, {
        "mechanical_ventilation_bool": False, "pf_ratio": float(d.NORMAL_PF_RATIO),
        "max_gamma": 0.0, d.TREATMENT: 0,
    })
    return filled.withColumn(
        "mechanical_ventilation_bool", F.col("mechanical_ventilation_bool").cast("int")
    ).select(*d.ANALYSIS_COLUMNS)
