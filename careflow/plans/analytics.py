"""Analytics run: tables -> result tables -> metrics store."""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from careflow.operators import allergies as al
from careflow.operators import conditions as co
from careflow.operators import encounters as en
from careflow.operators import patients as pa
from careflow.schemas import Tables
from careflow.plans.etl import require_utc
from careflow.sources.store import write_metrics

KPIS, METRICS, ADVANCED = "Kpis", "Metrics", "Advanced_metrics"
Results = dict[str, dict[str, DataFrame]]


def patient_results(t: Tables, as_of: dt.date) -> Results:
    p = t.patients
    return {
        KPIS: {"kpis": pa.patient_kpis(p, as_of)},
        METRICS: {"metrics": pa.patient_metrics(p, as_of)},
        ADVANCED: {
            "survival_trend": pa.survival_trend(p, as_of),
            "demographic_entropy": pa.demographic_entropy(p),
            "wealth_trajectory": pa.wealth_trajectory(p, as_of),
            "mortality_hazard": pa.mortality_hazard(p),
            "ten_year_trends": pa.ten_year_trends(p, as_of),
        },
    }


def condition_results(t: Tables, as_of: dt.date) -> Results:
    c = t.conditions
    return {
        KPIS: {"kpis": co.condition_kpis(c, as_of)},
        METRICS: {
            "top_disorder_conditions": co.top_disorder_conditions(c),
            "chronic_vs_acute": co.chronic_vs_acute(c, as_of),
            "disease_resolution_efficiency": co.disease_resolution_efficiency(c),
            "recurring_disorders": co.recurring_disorders(c),
            "comorbidity_pattern": co.comorbidity_pattern(c),
            "clinical_gravity": co.clinical_gravity(c),
        },
        ADVANCED: {
            "incidence_velocity": co.incidence_velocity(c),
            "concept_cooccurrence": co.concept_cooccurrence(c),
            "disease_transitions": co.disease_transitions(c),
            "recurrence_gap": co.recurrence_gap(c),
            "age_based_burden": co.age_based_burden(c, t.patients),
        },
    }


def encounter_results(t: Tables, as_of: dt.date) -> Results:
    e = en.fill_missing_fees(t.encounters)
    return {
        KPIS: {"kpis": en.encounter_kpis(e, as_of)},
        METRICS: {
            "encounters_by_type": en.encounters_by_type(e),
            "top_causes": en.top_causes(e),
            "coverage_vs_oop_by_type": en.coverage_vs_oop_by_type(e),
            "top_practitioners": en.top_practitioners(e),
            "fee_divergence_by_type": en.fee_divergence_by_type(e),
            "most_expensive_causes": en.most_expensive_causes(e),
        },
        ADVANCED: {
            "high_cost_anomalies": en.high_cost_anomalies(e),
            "duration_by_type": en.duration_by_type(e),
            "readmission_timeline": en.readmission_timeline(e),
            "uncovered_cost_trajectory": en.uncovered_cost_trajectory(e),
        },
    }


def allergy_results(t: Tables, as_of: dt.date) -> Results:
    a = t.allergies
    return {
        KPIS: {
            "kpis": al.allergy_kpis(a, t.patients, t.encounters, as_of),
            "risk_stratification": al.allergy_risk_stratification(a),
        },
        METRICS: {
            "top_causative_agents": al.top_causative_agents(a),
            "severity_distribution": al.severity_distribution(a),
            "discovery_trends": al.discovery_trends(a),
            "category_distribution": al.category_distribution(a),
        },
        ADVANCED: {
            "cross_reactivity": al.cross_reactivity(a),
            "nature_severity_matrix": al.nature_severity_matrix(a),
            "age_at_onset": al.age_at_onset(a, t.patients),
            "pollen_seasonality": al.pollen_seasonality(a),
        },
    }


FAMILIES = {
    "patients": patient_results,
    "conditions": condition_results,
    "encounters": encounter_results,
    "allergies": allergy_results,
}


def run_analytics(
    t: Tables, store: str, as_of: dt.date, updated_at: dt.datetime, keep: StorageLevel | None = StorageLevel.DISK_ONLY
) -> None:
    """Compute every result of every entity and replace its documents in the store.

    Results of one entity read its tables over and over, so the tables are resolved once and kept at the level ``keep`` until the run
    ends; blocks of lost executors are computed again. With None each result reads them from the store.
    """
    require_utc(t.patients.sparkSession)
    kept = [] if keep is None else [df.persist(keep) for df in (t.patients, t.conditions, t.encounters, t.allergies)]
    try:
        for entity, results in FAMILIES.items():
            for metric_type, tables in results(t, as_of).items():
                write_metrics(tables, store, entity, metric_type, updated_at)
    finally:
        for df in kept:
            df.unpersist()
