"""Fixed values of the two clinical sources: codes, limits, factors, labels."""

from __future__ import annotations

from mirador.operators.cleaning import Rule

# Drug codes and the daily dose (mg) from which treatment counts as high.
STEROID_DAILY_LIMIT = {
    7106: 200,  # hydrocortisone
    6922: 50,  # prednisolone
    8132: 40,  # methylprednisolone
    6995: 8,  # dexamethasone
}

# Respiratory modes that count as mechanical ventilation, by item.
VENTILATION_MODES = {
    9534: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13],
    6685: [1, 3, 5, 6, 8, 9, 10, 11, 12, 13, 14, 20, 22],
    8189: [16],
    12290: [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18],
    12347: [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18],
    12376: [1, 2],
}

# Item codes per measured feature.
FEATURE_ITEMS = {
    "sodium": [6840, 9555, 9924, 10284],
    "potassium": [6835, 9556, 9927, 10285],
    "creatinin": [6836, 9941, 14216],
    "leucocytes": [6779, 9965],
    "trombocytes": [9964, 6797, 10409, 14252],
    "temperature": [8658, 8659, 8662, 13058, 13059, 13060, 13061, 13062, 13063, 13952, 16110],
    "glucose": [9557, 6833, 9947],
    "bun": [6850, 9943],
    "crp": [6825, 10079],
    "bicarbonate": [6810, 9992, 9993],
    "heartfrequency": [6640],
    "lactate": [10053, 6837, 9580],
}

# Plausible ranges; validated rows and others may differ.
FEATURE_RULES = [
    Rule("sodium", True, lower=95, upper=165),
    Rule("potassium", True, lower=2, upper=8),
    Rule("potassium", False, lower=2.2, open_lower=True, upper=10),
    Rule("creatinin", True, lower=30),
    Rule("leucocytes", True, divide_above=70),
    Rule("temperature", lower=30, open_lower=True, upper=43),
    Rule("bun", upper=70),
    Rule("bicarbonate", lower=5, upper=50),
    Rule("heartfrequency", upper=300),
]

# The (statistic, feature) pairs of the analysis table.
FEATURE_PICKS = [
    ("median", "heartfrequency"),
    ("max", "bun"),
    ("max", "creatinin"),
    ("max", "crp"),
    ("max", "glucose"),
    ("max", "lactate"),
    ("max", "leucocytes"),
    ("max", "potassium"),
    ("max", "sodium"),
    ("max", "temperature"),
    ("min", "bicarbonate"),
]

# Vasopressors given by continuous pump, and factors to µg/kg/min by
# (given per kg, dose unit, rate unit): factor, and whether to divide by the weight.
VASOPRESSOR_ITEMS = [7179, 7178, 6818, 7229]
PUMP_CATEGORY = 65
VASOPRESSOR_MIN_RATE = 0.1
GAMMA_FACTORS = [
    (0, 11, 4, 1.0, True),  # µg/min
    (0, 10, 4, 1000.0, True),  # mg/min
    (0, 10, 5, 1000.0 / 60, True),  # mg/h
    (1, 11, 4, 1.0, False),  # µg/kg/min
    (1, 11, 5, 1.0 / 60, False),  # µg/kg/h
]

# Midpoints of the age, weight and height groups.
AGE_MIDPOINT = {"18-39": 29, "40-49": 45, "50-59": 55, "60-69": 65, "70-79": 75, "80+": 85}
WEIGHT_MIDPOINT = {
    "59-": 55, "60-69": 65, "70-79": 75, "80-89": 85, "90-99": 95, "100-109": 105, "110+": 115,
}
HEIGHT_MIDPOINT = {"159-": 155, "160-169": 165, "170-179": 175, "180-189": 185, "190+": 195}
GENDER = {"Man": 1, "Vrouw": 0}
DEFAULT_WEIGHT = 80

# Inspired-oxygen items in order of preference, arterial oxygen items likewise.
FIO2_SETTING_ITEMS = [12279, 6699, 12369, 16246]
OXYGEN_FLOW_ITEMS = [8845, 10387, 18587]
PAO2_ITEMS = [21214, 9996, 7433]
PH_ITEMS = [6848, 12310]
OXYGEN_DEVICE_ITEM = 8189
SPECIMEN_ITEM = 11646
KPA_UNIT = 152
KPA_TO_MMHG = 7.50061683
ROOM_AIR = 0.21

# Oxygen device codes by group, and the estimated fraction by flow (l/min).
DEVICE_GROUPS = {
    "nasal": [2, 7],
    "mask": [1, 3, 8, 9, 4, 18, 19],
    "reservoir": [10, 11, 13, 14, 15, 16, 17],
}
FLOW_STEPS = [
    ("nasal", 1, 2, 0.22),
    ("nasal", 2, 3, 0.25),
    ("nasal", 3, 4, 0.27),
    ("nasal", 4, 5, 0.30),
    ("nasal", 5, None, 0.35),
    ("mask", 1, 2, 0.22),
    ("mask", 2, 3, 0.25),
    ("mask", 3, 4, 0.27),
    ("mask", 4, 5, 0.30),
    ("mask", 5, 6, 0.35),
    ("mask", 6, 7, 0.40),
    ("mask", 7, 8, 0.45),
    ("mask", 8, None, 0.50),
    ("reservoir", 6, 7, 0.60),
    ("reservoir", 7, 8, 0.70),
    ("reservoir", 8, 9, 0.80),
    ("reservoir", 9, 10, 0.85),
    ("reservoir", 10, None, 0.90),
]

# Assumptions for missing values.
NORMAL_PF_RATIO = 400
MIN_PAO2 = 50
PH_RANGE = (6.8, 7.6)

# Steroid medications of the external source and their methylprednisolone factor.
STEROID_FACTORS = {
    "Dexamethasone": 5,
    "Hydrocortisone": 0.2,
    "Hydrocortisone Na Succ.": 0.2,
    "INV-Dexamethasone": 5,
    "MethylPREDNISolone Sodium Succ": 1,
    "Methylprednisolone": 1,
    "Methylprednisolone ACETATE": 1,
    "Methylprednisolone Na Succ Desensitization": 1,
    "PredniSONE": 1,
    "Prednisone": 1,
    "dexamethasone": 5,
    "hydrocorTISone": 0.2,
    "hydrocorTISone Sod Succ (PF)": 0.2,
    "hydrocorTISone Sod Succinate": 0.2,
    "hydrocortisone-acetic acid": 0.2,
    "methylPREDNISolone acetate": 1,
    "predniSONE": 1,
    "predniSONE Intensol": 1,
}
GIVEN_EVENTS = [
    "Delayed Administered",
    "Administered in Other Location",
    "Documented in O.R. Holding",
    "Partial Administered",
    "Delayed Started",
    "Confirmed",
    "Administered",
    "Started",
    "Restarted",
]
BLANK_DOSES = ("_", "___")
EXTERNAL_STEROID_LIMIT = 120
VENTILATED = ["InvasiveVent", "NonInvasiveVent"]

# Factors from mg/dl to mmol/l or µmol/l.
EXTERNAL_UNITS = {"max_bun": 0.357, "max_creatinine": 88.4, "max_glucose": 0.0555}

# External column names and the names of the common analysis table.
EXTERNAL_NAMES = {
    "stay_id": "admissionid",
    "age": "estimated_age",
    "weight": "estimated_weight",
    "height": "estimated_height",
    "ventilation": "mechanical_ventilation_bool",
    "min_pf_ratio": "pf_ratio",
    "max_gamma_vasopressor": "max_gamma",
    "min_ph": "arterial_ph",
    "mean_heart_rate": "median_heartfrequency",
    "max_creatinine": "max_creatinin",
    "crp": "max_crp",
    "max_wbc": "max_leucocytes",
}
ANALYSIS_COLUMNS = [
    "admissionid", "gender", "estimated_age", "estimated_weight", "estimated_height",
    "mortality_28d", "high_dose_steroids", "mechanical_ventilation_bool", "pf_ratio", "max_gamma",
    "arterial_ph", *[f"{m}_{f}" for m, f in FEATURE_PICKS],
]
ID, TREATMENT, OUTCOME = "admissionid", "high_dose_steroids", "mortality_28d"
