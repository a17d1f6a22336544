"""KPI and metric operators on small hand-made tables, with answers worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest

from careflow.operators import allergies as al
from careflow.operators import conditions as co
from careflow.operators import encounters as en
from careflow.operators import patients as pa
from conftest import date, one, rows

AS_OF = dt.date(2020, 6, 30)
PATIENTS = (
    "uuid string, birth_date date, death_date date, gender string, marital_status string, doctorate string, "
    "race string, family_income bigint, geolocated_city string, geolocated_state string"
)
CONDITIONS = (
    "uuid string, condition_record_date date, date_of_abetment date, medical_concepts string, associated_semantics string"
)
ENCOUNTERS = (
    "uuid string, visit_start timestamp, visit_end timestamp, practioner_id string, encounter_type string, "
    "encounter_reason string, visiting_base_fees double, visting_total_fees double, coverage double"
)
ALLERGIES = (
    "uuid string, allergy_detection_date date, allergy_cure_date date, allergy_code bigint, allergy_description string, "
    "category string, allergen_nature string, primary_symptom_description string, primary_symptom_severity string, "
    "secondary_symptom_severity string"
)


def patient(uuid, birth, death=None, gender="M", married="M", doctorate="No doctorate", race="white", income=100, city="c", state="Ohio"):
    return (uuid, date(birth), date(death), gender, married, doctorate, race, income, city, state)


def ts(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def visit(uuid, start, end=None, prac="d1", kind="wellness", reason="r", base=10.0, total=20.0, cov=5.0):
    return (uuid, ts(start), ts(end or start), prac, kind, reason, base, total, cov)


def condition(uuid, start, end=None, concept="A", semantics="disorder"):
    return (uuid, date(start), date(end), concept, semantics)


def allergy(uuid, on, cured=None, code=1, name="Dust", category="environment", nature="substance", reaction="Rash", first="MILD", second="MILD"):
    return (uuid, date(on), date(cured), code, name, category, nature, reaction, first, second)


def by_period(df):
    return {r.period: r.asDict() for r in df.collect()}


# --- patients ------------------------------------------------------------------------------


def test_patient_snapshot_boundaries(spark):
    week_ago = "2020-06-23"
    df = spark.createDataFrame([
        patient("born_on_ref", week_ago),
        patient("born_after", "2020-06-24"),
        patient("died_on_ref", "1950-01-01", week_ago),
        patient("died_before", "1950-01-01", "2020-06-22"),
        patient("died_after", "1950-01-01", "2020-06-24", gender="F"),
    ], PATIENTS)
    got = by_period(pa.patient_kpis(df, AS_OF))
    assert got["current"]["total_patients"] == 5
    assert got["current"]["active_patient_rate"] == 40
    week = got["last_week"]
    assert week["total_patients"] == 3  # born on ref, died on ref, died after ref
    assert week["active_patient_rate"] == 66  # died_after was still alive then
    assert week["gender_balance_ratio"] == 200
    recorded = by_period(pa.patient_kpis(df, AS_OF, status="recorded"))["last_week"]
    assert recorded["total_patients"] == 3 and recorded["active_patient_rate"] == 33


def test_empty_period_is_left_out(spark):
    df = spark.createDataFrame([patient("p", "2020-06-29")], PATIENTS)
    assert set(by_period(pa.patient_kpis(df, AS_OF))) == {"current"}
    assert pa.patient_kpis(spark.createDataFrame([], PATIENTS), AS_OF).count() == 0


def test_patient_kpis_without_females_and_doctorate_spelling(spark):
    df = spark.createDataFrame([
        patient("a", "1990-06-30", income=1, doctorate="No Doctorate"), patient("b", "1990-06-30", income=2, doctorate="No doctorate"),
        patient("c", "1990-06-30", income=3, doctorate="PhD", married="S"), patient("d", "1990-06-30", income=4, doctorate=None),
    ], PATIENTS)
    k = by_period(pa.patient_kpis(df, AS_OF))["current"]
    assert k["gender_balance_ratio"] == 400
    assert (k["mean_family_income"], k["median_family_income"]) == (2, 2)
    assert (k["married_rate"], k["higher_education_rate"]) == (75.0, 25.0)
    assert k["avg_patient_age"] == 30.0


def test_all_living_cohort_and_metrics(spark):
    df = spark.createDataFrame([patient(str(i), f"{y}-01-01", income=i * 10, race="ab"[i % 2]) for i, y in enumerate((1950, 1980, 2010, 1990))], PATIENTS)
    got = {r.metric: r.value for r in pa.patient_metrics(df, AS_OF).collect()}
    assert got["mortality_rate"] == 0.0
    assert got["economic_dependence_ratio"] == 100.0
    assert got["cultural_diversity_score"] == 50.0
    assert len(got) == 5


def test_correlation_of_constant_is_zero(spark):
    df = spark.createDataFrame([patient("a", "1980-01-01"), patient("b", "1990-01-01")], PATIENTS)
    assert one(pa.age_wealth_correlation(df, AS_OF))["age_wealth_correlation"] == 0.0


def test_ten_year_trends(spark):
    df = spark.createDataFrame([patient("a", "1980-01-01", "2015-05-05"), patient("b", "2018-01-01", race="x")], PATIENTS)
    got = {r.year: r for r in pa.ten_year_trends(df, AS_OF).collect()}
    assert sorted(got) == list(range(2010, 2020))
    assert got[2014].economic_dependence == 0 and got[2014].mortality_rate == 0.0
    assert got[2015].mortality_rate == 100.0 and got[2015].economic_dependence == 0
    assert got[2016].cultural_diversity == 0  # nobody left
    assert got[2019].economic_dependence == 100  # one child, nobody working


def test_wealth_bands(spark):
    births = {"2014-06-01": 60, "2015-06-01": 50, "2020-06-01": 40, "1935-01-01": 850, "1934-01-01": 999}
    df = spark.createDataFrame([patient(b, b, income=i) for b, i in births.items()], PATIENTS)
    got = {r.age_band: (r.avg_income, r.avg_wealth_velocity) for r in pa.wealth_trajectory(df, AS_OF).collect()}
    assert len(got) == 17
    assert got["0-5"] == (45, 10)  # ages 5 and 0; the newborn has no velocity
    assert got["6-10"] == (60, 10)
    assert got["81-85"] == (850, 10)
    assert got["11-15"] == (0, 0)


# --- conditions ----------------------------------------------------------------------------


def test_condition_kpis_at_boundaries(spark):
    df = spark.createDataFrame([
        condition("p", "2020-05-31"), condition("p", "2020-05-30", concept="B"),          # 30 and 31 days
        condition("q", "2020-04-01"), condition("q", "2020-04-02"),                        # open 90 and 89 days
        condition("r", "2020-01-01", "2020-06-23", "C"), condition("r", "2020-01-01", "2020-06-24", "D"),
    ], CONDITIONS)
    got = by_period(co.condition_kpis(df, AS_OF))
    now = got["current"]
    assert now["current_active_burden"] == 4 and now["total_diagnoses"] == 6
    assert now["admission_rate_last_30_days"] == 1
    assert now["chronic_condition_burden"] == 1
    assert now["global_recovery_rate"] == 33.33
    assert now["patient_complexity_score"] == 2
    assert now["average_time_to_cure"] == 175  # ceil((174 + 175) / 2)
    week = got["last_week"]
    assert week["current_active_burden"] == 5  # the cure of 24 June lies ahead
    assert week["patient_complexity_score"] == 1
    assert week["average_time_to_cure"] == 174
    assert got["last_month"]["total_diagnoses"] == 6 and set(got) == {"current", "last_week", "last_month"}


def test_condition_metrics(spark):
    df = spark.createDataFrame([
        condition("p", "2020-04-01"), condition("p", "2020-04-02", concept="B"),
        condition("q", "2020-01-01", "2020-01-11"), condition("q", "2020-03-01", "2020-03-06"), condition("q", "2020-01-01", "2020-01-02", "F", "finding"),
        condition("r", "2020-06-01", concept="B"), condition("r", "2020-06-02", concept="B"),
    ], CONDITIONS)
    assert rows(co.top_disorder_conditions(df)) == [("B", 3), ("A", 1)]
    assert dict(rows(co.chronic_vs_acute(df, AS_OF))) == {"chronic": 1, "acute": 5}
    assert rows(co.disease_resolution_efficiency(df)) == [("A", 2, 7)]
    assert rows(co.recurring_disorders(df)) == [("A", 1), ("B", 1)]
    assert rows(co.comorbidity_pattern(df)) == [(2, 2)]
    assert one(co.average_open_conditions(df))["avg_open_conditions"] == 2
    gravity = {r.medical_concepts: (r.patients, r.score) for r in co.clinical_gravity(df).collect()}
    assert gravity == {"A": (1, 1.0), "B": (2, 0.0)}  # B: rows carry 1, 0 and 0 others


def test_age_based_burden_range(spark):
    patients = spark.createDataFrame([("p", date("2000-01-01"))], "uuid string, birth_date date")
    df = spark.createDataFrame([
        condition("p", "1999-01-01"), condition("p", "2005-01-01"), condition("p", "2005-01-01"), condition("p", "2015-06-01"), condition("x", "2005-01-01"),
    ], CONDITIONS)
    assert rows(co.age_based_burden(df, patients), "age_from") == [(0, "0-9", 2), (10, "10-19", 1)]


def test_incidence_velocity_months(spark):
    df = spark.createDataFrame([condition("p", "2020-01-05"), condition("q", "2019-01-09"), condition("q", "2019-02-09"), condition("q", "2019-02-09", concept="Z")], CONDITIONS)
    assert rows(co.incidence_velocity(df, k=1), "month_number") == [("A", 1, "Jan", 2), ("A", 2, "Feb", 1)]


# --- encounters ----------------------------------------------------------------------------


def test_encounter_kpis(spark):
    df = spark.createDataFrame([
        visit("p", "2020-06-23T00:00:00", "2020-06-23T02:00:00"),
        visit("p", "2020-06-23T00:00:01", "2020-06-23T04:00:01", prac=None, cov=None),
        visit("q", "2020-06-29T10:00:00", None, base=40.0, total=50.0),
    ], ENCOUNTERS)
    got = by_period(en.encounter_kpis(df, AS_OF))
    now = got["current"]
    assert now["total_visit_volume"] == 3 and now["unique_patients_seen"] == 2
    assert now["total_revenue_generated"] == 90.0 and now["total_covered_amount"] == 10.0
    assert now["average_encounter_duration_hours"] == 2.0
    assert now["average_patient_out_of_pocket"] == 26.67  # 15, 20, 45
    assert now["average_base_fee"] == 20.0
    assert now["average_practitioner_load"] == 1.5  # d1 twice, no practitioner once
    week = got["last_week"]  # only the visit at midnight of the reference day counts
    assert week["total_visit_volume"] == 1 and week["unique_patients_seen"] == 1
    assert "last_month" not in got


def test_encounter_metrics(spark):
    df = spark.createDataFrame([
        visit("p", "2020-01-01T00:00:00"), visit("p", "2020-01-20T00:00:00", prac="d2"), visit("q", "2020-01-05T00:00:00", kind=None, reason=None),
        visit("q", "2020-03-05T00:00:00", prac=None, total=100.0, cov=None, reason="s"),
    ], ENCOUNTERS)
    assert rows(en.encounters_by_type(df)) == [("wellness", 3)]
    assert rows(en.top_causes(df)) == [("r", 2), ("s", 1)]
    assert rows(en.top_practitioners(df, 1)) == [("d1", 2)]
    assert rows(en.most_expensive_causes(df)) == [("s", 100.0), ("r", 20.0)]
    assert rows(en.coverage_vs_oop_by_type(df)) == [("wellness", 3.33, 43.33)]  # unknown coverage counts as none
    assert rows(en.fee_divergence_by_type(df)) == [("wellness", 10.0, 46.67)]
    assert rows(en.readmission_timeline(df), "month_start") == [
        (date("2020-01-01"), 2, 1, "Jan 2020"), (date("2020-03-01"), 1, 0, "Mar 2020"),
    ]
    assert [r.avg_out_of_pocket for r in en.uncovered_cost_trajectory(df, 1).collect()] == [100.0]


# --- allergies -----------------------------------------------------------------------------


def test_allergy_kpis(spark):
    patients = spark.createDataFrame([patient(u, "1990-01-01") for u in "abcd"] + [patient("dead", "1950-01-01", "2020-01-01")], PATIENTS)
    encounters = spark.createDataFrame([
        visit("a", "2020-06-01T08:00:00"), visit("a", "2020-06-25T08:00:00"),       # back after 24 days, after last week's date
        visit("b", "2020-01-01T08:00:00"), visit("b", "2020-02-01T08:00:00"),       # 31 days
        visit("d", "2020-01-01T08:00:00"), visit("d", "2020-01-02T08:00:00"),       # not allergic
    ], ENCOUNTERS)
    allergies = spark.createDataFrame([
        allergy("a", "2020-01-01", code=1, name="Penicillin", category="medication"),
        allergy("a", "2020-06-25", code=2, name="penicillin", nature="drug", first="SEVERE"),
        allergy("b", "2020-01-01", "2020-06-24", code=1),
        allergy("b", "2020-02-01", code=1),
        allergy("c", "2020-06-26", code=3, name="Penicillin", reaction="Anaphylaxis"),
    ], ALLERGIES)
    got = by_period(al.allergy_kpis(allergies, patients, encounters, AS_OF))
    now, week = got["current"], got["last_week"]
    assert now["total_allergic_population"] == 3 and week["total_allergic_population"] == 2
    assert now["active_allergy_percentage"] == 80.0 and week["active_allergy_percentage"] == 100.0
    assert now["severe_allergy_incidence_rate"] == 20.0 and week["severe_allergy_incidence_rate"] == 0.0
    assert now["allergic_patient_rate"] == 60.0 and week["allergic_patient_rate"] == 50.0
    assert now["penicillin_allergy_delabeling_eligibility_rate"] == 33.33
    assert week["penicillin_allergy_delabeling_eligibility_rate"] == 100.0
    assert now["allergy_related_readmission_rate"] == 33.33 and week["allergy_related_readmission_rate"] == 0.0
    assert now["poly_allergen_patient_rate"] == 33.33 and week["poly_allergen_patient_rate"] == 0.0
    assert now["drug_hypersensitivity_rate"] == 33.33 and week["drug_hypersensitivity_rate"] == 50.0


def test_no_penicillin_rows(spark):
    patients = spark.createDataFrame([patient("a", "1990-01-01")], PATIENTS)
    encounters = spark.createDataFrame([], ENCOUNTERS)
    allergies = spark.createDataFrame([allergy("a", "2020-01-01")], ALLERGIES)
    k = by_period(al.allergy_kpis(allergies, patients, encounters, AS_OF))["current"]
    assert k["penicillin_allergy_delabeling_eligibility_rate"] == 0.0
    assert k["allergy_related_readmission_rate"] == 0.0


def test_allergy_metrics(spark):
    df = spark.createDataFrame([
        allergy("a", "2020-01-01", nature=None), allergy("a", "2019-02-01", name="Nuts", category="food", code=2),
        allergy("b", "2020-02-01"), allergy("b", "2020-02-05", name="Nuts", code=2, first="SEVERE"), allergy("b", None, code=5),
    ], ALLERGIES)
    assert rows(al.top_causative_agents(df)) == [("Dust", 3), ("Nuts", 2)]
    assert dict(rows(al.severity_distribution(df))) == {"MILD": 4, "SEVERE": 1}
    assert sorted(rows(al.discovery_trends(df))) == [(0, "environment", 1), (2019, "food", 1), (2020, "environment", 3)]
    assert dict(rows(al.category_distribution(df))) == {"environment": 4, "food": 1}
    assert sorted(rows(al.allergy_risk_stratification(df))) == [("Unknown", 1, 50.0), ("substance", 2, 100.0)]
    assert rows(al.cross_reactivity(df)) == [("Dust", "Nuts", 3)]  # 1 x 1 for a, 2 x 1 for b
    season = {r.month: (r["count"], r.mom_growth_rate) for r in al.pollen_seasonality(df).collect()}
    assert season["Jan"][1] in (0.0, 0.0) and season["Feb"] == (2, 100.0)


@pytest.mark.parametrize("born,label", [("2020-06-01", "-10--1"), ("2010-01-01", "10-19")])
def test_age_at_onset_keeps_negative_ages(spark, born, label):
    patients = spark.createDataFrame([("a", date(born))], "uuid string, birth_date date")
    df = spark.createDataFrame([allergy("a", "2020-01-02")], ALLERGIES)
    assert rows(al.age_at_onset(df, patients).select("age_group", "count")) == [(label, 1)]
