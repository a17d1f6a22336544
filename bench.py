"""Wall time of the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPS
(default 2 timed runs after one warm-up; the best is reported).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "p_kpis_by_period", "p14_income_inequality_index", "p15_economic_dependence_trend", "p18_survival_trend",
    "p19_demographic_entropy", "p21_mortality_hazard",
    "c_kpis_by_period", "c12_disease_resolution_efficiency", "c15_clinical_gravity", "c16_incidence_velocity",
    "c17_concept_cooccurrence", "c18_disease_transition_patterns", "c19_average_condition_recurrence_gap",
    "c20_age_based_burden",
    "e_kpis_by_period", "e13_coverage_vs_oop_by_type", "e17_high_cost_anomaly_index", "e19_readmission_timeline",
    "a_kpis_by_period", "a15_cross_reactivity_risk_matrix", "a18_pollen_seasonality_acceleration",
    "g5_patient_kpis_by_state", "g7_encounter_kpis_by_state",
    "t15_known_parents", "d1_duplicate_keys",
    "s2_keyed_upsert", "t17_clean_medications", "g6_condition_kpis_by_state", "g8_allergy_kpis_by_state", "r11_executive_summary",
]


def main() -> None:
    from careflow.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("careflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def jobs() -> int:
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("bench"))

    times: dict[str, float] = {}
    n_jobs: dict[str, int] = {}
    spark.sparkContext.setJobGroup("bench", "headline queries")
    for name in HEADLINE:
        before = jobs()
        run(name)
        n_jobs[name] = jobs() - before
        times[name] = round(min(run(name) for _ in range(reps)), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "jobs": n_jobs, "cores": int(cpus), "spark": spark.version, "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
