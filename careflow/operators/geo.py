"""Per-state KPIs: each family is one grouped aggregate over a state spine.

Child tables have no state of their own. They are aggregated per patient first (map-side combine,
so a patient with a third of all rows is one row afterwards), joined to the patient's state, and
summed per state. Rows without a state are dropped; states without rows show zeros.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.functions.columns import ceiled, day, money, pct, ratio, rounded, trunc, years_between
from careflow.operators import allergies as al
from careflow.operators.conditions import CHRONIC_DAYS
from careflow.operators.encounters import BASE, COVERAGE, TOTAL, duration_hours, exact_mean, exact_sums, exact_total
from careflow.operators.patients import NO_DOCTORATE
from careflow.operators.statistics import exact_median
from careflow.schemas import US_STATES, Tables

STATE = "geolocated_state"


def us_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in US_STATES], f"{STATE} string")


def filled(column: str) -> Column:
    """Not NULL and not empty."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def with_state(patients: DataFrame) -> DataFrame:
    """Patients that have a state."""
    return patients.where(filled(STATE))


def attach_state(per_patient: DataFrame, patients: DataFrame) -> DataFrame:
    """The parent's state on rows keyed by ``uuid``."""
    return per_patient.join(with_state(patients).select("uuid", STATE), "uuid")


def scaffold(states: DataFrame, *parts: DataFrame, values: Sequence[Column]) -> DataFrame:
    """Every state of the spine, with 0 where a report has no row."""
    out = states.select(STATE)
    for part in parts:
        out = out.join(part, STATE, "left")
    numbers = [c for c in out.columns if c != STATE]
    return out.fillna(0, numbers).select(STATE, *values)


def patient_kpis_by_state(patients: DataFrame, states: DataFrame, as_of: dt.date) -> DataFrame:
    """P1-P8 per state; the median is exact here."""
    people = with_state(patients)
    alive = F.col("death_date").isNull()
    stats = people.groupBy(STATE).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(alive).alias("alive"),
        F.count_if(F.col("gender") == "M").alias("males"),
        F.count_if(F.col("gender") == "F").alias("females"),
        F.avg(F.when(alive, F.col("family_income"))).alias("mean"),
        F.avg(F.when(alive, F.coalesce(years_between(F.col("birth_date"), day(as_of)), F.lit(0.0)))).alias("age"),
        F.count_if(F.col("marital_status") == "M").alias("married"),
        F.count_if(filled("doctorate") & (F.lower("doctorate") != NO_DOCTORATE)).alias("doctors"),
    )
    median = exact_median(people.where(alive), "family_income", [STATE])
    n = F.col("n")
    return scaffold(states, stats, median, values=[
        n.alias("total_patients"),
        trunc(pct(F.col("alive"), n)).alias("active_patient_rate"),
        trunc(pct(F.col("males"), F.greatest(F.col("females"), F.lit(1)))).alias("gender_balance_ratio"),
        trunc(F.col("mean")).alias("mean_family_income"),
        trunc(F.col("median")).alias("median_family_income"),
        rounded(F.col("age"), 1).alias("avg_patient_age"),
        pct(F.col("married"), n, 1).alias("married_rate"),
        pct(F.col("doctors"), n, 1).alias("higher_education_rate"),
    ])


def condition_kpis_by_state(
    conditions: DataFrame, patients: DataFrame, states: DataFrame, as_of: dt.date
) -> DataFrame:
    """C1-C8 per state."""
    record, end = F.col("condition_record_date"), F.col("date_of_abetment")
    sums = {
        "n": F.count(F.lit(1)),
        "resolved": F.count(end),
        "days": F.sum(F.datediff(end, record)),
        "timed": F.count(F.datediff(end, record)),
        "recent": F.count_if(record >= F.date_sub(day(as_of), 30)),
        "chronic": F.count_if(end.isNull() & (F.datediff(day(as_of), record) >= CHRONIC_DAYS)),
    }
    rows = _sum_by_state(conditions, patients, sums)
    named = (
        conditions.where(filled("medical_concepts"))
        .groupBy("uuid", "medical_concepts").agg(F.count(end).alias("resolved"))
    )
    located = attach_state(named, patients)
    per_concept = located.groupBy(STATE, "medical_concepts").agg(F.lit(1).alias("one"))
    concepts = per_concept.groupBy(STATE).agg(F.count(F.lit(1)).alias("concepts"))
    per_patient = located.groupBy(STATE, "uuid").agg(F.count_if(F.col("resolved") > 0).alias("k")).where("k > 0")
    complexity = per_patient.groupBy(STATE).agg(F.avg("k").alias("complexity"))
    n = F.col("n")
    return scaffold(states, rows, concepts, complexity, values=[
        (n - F.col("resolved")).alias("current_active_burden"),
        pct(F.col("resolved"), n, 1).alias("global_recovery_rate"),
        ceiled(F.col("complexity")).alias("patient_complexity_score"),
        ceiled(ratio(F.col("days"), F.col("timed"))).alias("average_time_to_cure"),
        F.col("recent").alias("admission_rate_last_30_days"),
        n.alias("total_diagnoses"),
        F.col("concepts").alias("unique_conditions"),
        F.col("chronic").alias("chronic_condition_burden"),
    ])


def encounter_kpis_by_state(
    encounters: DataFrame, patients: DataFrame, states: DataFrame, as_of: dt.date, load: bool = True
) -> DataFrame:
    """E1-E9 per state. NULL fees count as 0, the out-of-pocket share is never negative and
    encounters without a practitioner do not enter the practitioner load, which takes a pass of its own and may be left out."""
    covered = f"coalesce({COVERAGE}, 0.0D)"
    sums = {
        "n": F.count(F.lit(1)),
        "hours": F.sum(duration_hours()),
        "timed": F.count(duration_hours()),
        "recent": F.count_if(F.to_date("visit_start") >= F.date_sub(day(as_of), 30)),
        "assigned": F.count_if(filled("practioner_id")),
    }
    amounts = exact_sums(
        revenue=f"coalesce({TOTAL}, 0.0D)", oop=f"greatest(0.0D, coalesce({TOTAL}, 0.0D) - {covered})", base=f"coalesce({BASE}, 0.0D)", covered=covered,
    )
    # one row a patient travels to the states, with all sums; of practitioners only the names do
    per_patient = encounters.groupBy("uuid").agg(*[c.alias(k) for k, c in sums.items()], *amounts)
    numbers = [c for c in per_patient.columns if c != "uuid"]
    rows = attach_state(per_patient, patients).groupBy(STATE).agg(*[F.sum(c).alias(c) for c in numbers], F.count(F.lit(1)).alias("people"))
    parts = [rows]
    if load:
        treated = attach_state(encounters.where(filled("practioner_id")).select("uuid", "practioner_id").distinct(), patients)
        parts.append(treated.select(STATE, "practioner_id").distinct().groupBy(STATE).agg(F.count(F.lit(1)).alias("practitioners")))
    n = F.col("n")
    return scaffold(states, *parts, values=[
        n.alias("total_visit_volume"),
        money(exact_total("revenue")).alias("total_revenue_generated"),
        rounded(ratio(F.col("hours"), F.col("timed"))).alias("average_encounter_duration_hours"),
        rounded(exact_mean("oop")).alias("average_patient_out_of_pocket"),
        rounded(exact_mean("base")).alias("average_base_fee"),
        money(exact_total("covered")).alias("total_covered_amount"),
        F.col("people").alias("unique_patients_seen"),
        *([rounded(F.try_divide(F.col("assigned").cast("double"), F.col("practitioners"))).alias("average_practitioner_load")] if load else []),
        F.col("recent").alias("encounters_30d"),
    ])


def allergy_kpis_by_state(
    allergies: DataFrame, patients: DataFrame, encounters: DataFrame, states: DataFrame
) -> DataFrame:
    """A1-A8 per state. The poly-allergen rate is taken over patients with a coded allergy."""
    sums = {
        "n": F.count(F.lit(1)),
        "cured": F.count("allergy_cure_date"),
        "severe": F.count_if(F.col("primary_symptom_severity") == "SEVERE"),
        "penicillin": F.count_if(F.expr(al.IS_PENICILLIN)),
        "eligible": F.count_if(
            F.expr(al.IS_PENICILLIN)
            & ~F.col("primary_symptom_severity").eqNullSafe("SEVERE")
            & ~F.col("secondary_symptom_severity").eqNullSafe("SEVERE")
            & ~F.col("primary_symptom_description").eqNullSafe(al.ANAPHYLAXIS)
        ),
    }
    rows = _sum_by_state(allergies, patients, sums)
    people = (
        attach_state(al.allergic_patients(allergies, encounters), patients)
        .groupBy(STATE)
        .agg(
            F.count(F.lit(1)).alias("allergic"),
            F.count("readmitted_on").alias("readmitted"),
            F.count_if(F.col("codes") >= 1).alias("coded"),
            F.count_if(F.col("codes") >= 2).alias("poly"),
            F.count_if("drug").alias("drug"),
        )
    )
    everyone = with_state(patients).groupBy(STATE).agg(F.count(F.lit(1)).alias("everyone"))
    n, allergic = F.col("n"), F.col("allergic")
    return scaffold(states, rows, people, everyone, values=[
        allergic.alias("total_allergic_population"),
        pct(n - F.col("cured"), n, 2).alias("active_allergy_percentage"),
        pct(F.col("severe"), n, 2).alias("severe_allergy_incidence_rate"),
        pct(allergic, F.col("everyone"), 2).alias("allergic_patient_rate"),
        pct(F.col("eligible"), F.col("penicillin"), 2).alias("penicillin_allergy_delabeling_eligibility_rate"),
        pct(F.col("readmitted"), allergic, 2).alias("allergy_related_readmission_rate"),
        pct(F.col("poly"), F.col("coded"), 2).alias("poly_allergen_patient_rate"),
        pct(F.col("drug"), allergic, 2).alias("drug_hypersensitivity_rate"),
    ])


def _sum_by_state(child: DataFrame, patients: DataFrame, sums: dict[str, Column]) -> DataFrame:
    per_patient = child.groupBy("uuid").agg(*[c.alias(n) for n, c in sums.items()])
    return attach_state(per_patient, patients).groupBy(STATE).agg(*[F.sum(n).alias(n) for n in sums])


# KPI ids of each family and the alternative ids reports use for them.
FAMILIES = {
    "patients": [
        "total_patients", "active_patient_rate", "gender_balance_ratio", "mean_family_income",
        "median_family_income", "avg_patient_age", "married_rate", "higher_education_rate",
    ],
    "conditions": [
        "current_active_burden", "global_recovery_rate", "patient_complexity_score",
        "average_time_to_cure", "admission_rate_last_30_days", "total_diagnoses",
        "unique_conditions", "chronic_condition_burden",
    ],
    "encounters": [
        "total_visit_volume", "total_revenue_generated", "average_encounter_duration_hours",
        "average_patient_out_of_pocket", "average_base_fee", "total_covered_amount",
        "unique_patients_seen", "average_practitioner_load", "encounters_30d",
    ],
    "allergies": [
        "total_allergic_population", "active_allergy_percentage", "severe_allergy_incidence_rate",
        "allergic_patient_rate", "penicillin_allergy_delabeling_eligibility_rate",
        "allergy_related_readmission_rate", "poly_allergen_patient_rate",
        "drug_hypersensitivity_rate",
    ],
}
ALIASES = {
    "active_condition_burden": "current_active_burden",
    "avg_cure_time": "average_time_to_cure",
    "active_allergy_rate": "active_allergy_percentage",
    "severe_incident_rate": "severe_allergy_incidence_rate",
    "total_revenue": "total_revenue_generated",
    "avg_out_of_pocket": "average_patient_out_of_pocket",
    "insurer_covered": "total_covered_amount",
}


def family_by_state(family: str, tables: Tables, states: DataFrame, as_of: dt.date, kpi: str | None = None) -> DataFrame:
    """A family's KPIs; where only one ``kpi`` is wanted, parts that it does not depend on may be missing."""
    if family == "patients":
        return patient_kpis_by_state(tables.patients, states, as_of)
    if family == "conditions":
        return condition_kpis_by_state(tables.conditions, tables.patients, states, as_of)
    if family == "encounters":
        return encounter_kpis_by_state(tables.encounters, tables.patients, states, as_of, load=kpi in (None, "average_practitioner_load"))
    return allergy_kpis_by_state(tables.allergies, tables.patients, tables.encounters, states)


def state_kpi(kpi_id: str, tables: Tables, states: DataFrame, as_of: dt.date) -> DataFrame:
    """G1: one KPI per state, by id or alias. Unused columns of the family are pruned away."""
    name = ALIASES.get(kpi_id, kpi_id)
    family = next((f for f, ids in FAMILIES.items() if name in ids), None)
    if family is None:
        raise ValueError(f"invalid KPI id: {kpi_id}")
    return family_by_state(family, tables, states, as_of, name).select(
        STATE,
        F.lit(kpi_id).alias("kpi_id"),
        F.col(name).cast("double").alias("value"),
        F.lit(0.0).alias("trend"),
        F.lit(False).alias("is_simulated"),
    )
