"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mirador.plans import QUERIES  # noqa: E402
from mirador.session import local_session  # noqa: E402
from mirador.sources.workspace import Workspace  # noqa: E402

HEADLINE = [
    "anchor_window_filter", "compound_code_filter", "code_list_semi", "band_join",
    "asof_priority_match", "onset_range_join", "person_to_stay_rollup", "covariate_assembly",
    "daily_dose_dense", "feature_stats", "feature_select_wide", "dose_equivalent_total",
    "all_rows_flag", "dedup_first", "measurement_cohort", "oxygenation_match", "analysis_table",
    "scale_impute", "feature_screen", "psm_match", "aipw_ate", "auc_exact", "roc_table",
    "calibration_table", "model_summary", "subgroup_describe", "ite_curve", "bootstrap_ci",
    "wasserstein_1d", "t_learner_lr", "x_learner_lr", "effect_study",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    names = list(QUERIES) if names == ["all"] else names
    spark = local_session(cpus, "16g")
    QUERIES["unit_spine"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            with Workspace(spark):
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
