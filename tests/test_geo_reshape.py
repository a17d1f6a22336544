from __future__ import annotations

import datetime as dt

import pytest

from careflow.operators import geo, reshape as rs
from careflow.schemas import US_STATES, Tables
from conftest import rows
from test_entities import (
    ALLERGIES, AS_OF, CONDITIONS, ENCOUNTERS, PATIENTS, allergy, condition, patient, visit,
)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(
        patients=spark.createDataFrame([
            patient("a", "1990-06-30", income=1), patient("b", "1990-06-30", income=2), patient("c", "1990-06-30", gender="F", income=5, doctorate=None),
            patient("d", "1990-06-30", income=8, doctorate="MD"), patient("dead", "1950-01-01", "2019-01-01", income=900),
            patient("e", "1990-06-30", state="Iowa"), patient("n", "1990-06-30", state=None), patient("x", "1990-06-30", state="Ontario"), patient("z", "1990-06-30", state=""),
        ], PATIENTS),
        conditions=spark.createDataFrame([
            condition("a", "2020-05-31"), condition("a", "2020-04-01", concept=None), condition("a", "2020-01-01", "2020-01-04", "B"),
            condition("b", "2020-01-01", "2020-01-03", "B"), condition("b", "2020-01-01", "2020-01-03", "C"), condition("n", "2020-01-01"), condition("orphan", "2020-01-01"),
        ], CONDITIONS),
        encounters=spark.createDataFrame([
            visit("a", "2020-05-31T08:00:00", "2020-05-31T10:00:00", cov=50.0), visit("a", "2020-06-20T08:00:00", prac=None, cov=None),
            visit("b", "2020-01-01T08:00:00", prac="d2", base=None, total=None), visit("n", "2020-01-01T00:00:00"),
        ], ENCOUNTERS),
        allergies=spark.createDataFrame([
            allergy("a", "2020-01-01", name="Penicillin", first=None), allergy("a", "2020-01-02", code=2), allergy("b", "2020-01-01", code=None, category="medication"),
            allergy("x", "2020-01-01"),
        ], ALLERGIES),
    )


def state(df, name):
    return df.where(df.geolocated_state == name).collect()[0].asDict()


def test_spine_has_every_state_and_no_other(spark, tables):
    df = geo.patient_kpis_by_state(tables.patients, geo.us_states(spark), AS_OF)
    assert [r[0] for r in rows(df.select("geolocated_state"), "geolocated_state")] == sorted(US_STATES)
    assert len(US_STATES) == 50
    assert all(v == 0 for k, v in state(df, "Texas").items() if k != "geolocated_state")


def test_patient_kpis_by_state(spark, tables):
    k = state(geo.patient_kpis_by_state(tables.patients, geo.us_states(spark), AS_OF), "Ohio")
    assert (k["total_patients"], k["active_patient_rate"], k["gender_balance_ratio"]) == (5, 80, 400)
    assert (k["mean_family_income"], k["median_family_income"]) == (4, 3)  # exact median 3.5
    assert (k["avg_patient_age"], k["married_rate"], k["higher_education_rate"]) == (30.0, 100.0, 20.0)


def test_condition_kpis_by_state(spark, tables):
    df = geo.condition_kpis_by_state(tables.conditions, tables.patients, geo.us_states(spark), AS_OF)
    k = state(df, "Ohio")
    assert (k["total_diagnoses"], k["current_active_burden"], k["global_recovery_rate"]) == (5, 2, 60.0)
    assert (k["patient_complexity_score"], k["average_time_to_cure"]) == (2, 3)
    assert (k["admission_rate_last_30_days"], k["unique_conditions"], k["chronic_condition_burden"]) == (1, 3, 1)
    assert sum(r.total_diagnoses for r in df.collect()) == 5


def test_encounter_kpis_by_state(spark, tables):
    k = state(geo.encounter_kpis_by_state(tables.encounters, tables.patients, geo.us_states(spark), AS_OF), "Ohio")
    assert (k["total_visit_volume"], k["total_revenue_generated"], k["unique_patients_seen"]) == (3, 40.0, 2)
    assert k["average_encounter_duration_hours"] == 0.67
    assert k["average_patient_out_of_pocket"] == 6.67  # 0, 20 and 0: never negative
    assert k["average_base_fee"] == 6.67 and k["total_covered_amount"] == 55.0
    assert k["average_practitioner_load"] == 1.0 and k["encounters_30d"] == 2


def test_allergy_kpis_by_state(spark, tables):
    k = state(geo.allergy_kpis_by_state(tables.allergies, tables.patients, tables.encounters, geo.us_states(spark)), "Ohio")
    assert k["total_allergic_population"] == 2 and k["allergic_patient_rate"] == 40.0
    assert k["penicillin_allergy_delabeling_eligibility_rate"] == 100.0  # an unknown severity is not SEVERE
    assert k["poly_allergen_patient_rate"] == 100.0  # of patients with a code
    assert k["allergy_related_readmission_rate"] == 50.0 and k["drug_hypersensitivity_rate"] == 50.0


@pytest.mark.parametrize("kpi", [k for ids in geo.FAMILIES.values() for k in ids] + list(geo.ALIASES))
def test_router_knows_every_kpi(spark, tables, kpi):
    df = geo.state_kpi(kpi, tables, geo.us_states(spark), AS_OF)
    assert df.columns == ["geolocated_state", "kpi_id", "value", "trend", "is_simulated"]


def test_router_rejects_unknown_kpi(spark, tables):
    with pytest.raises(ValueError):
        geo.state_kpi("nonsense", tables, geo.us_states(spark), AS_OF)


def test_kpi_delta(spark):
    kpis = spark.createDataFrame(
        [("current", 10, 5.0, 0.0), ("last_week", 8, 5.0, 0.0), ("last_year", 5, 10.0, 0.0)],
        "period string, total_patients bigint, average_base_fee double, married_rate double",
    )
    got = {(r.kpi, r.period): (r.difference, r.percent_change, r.direction) for r in rs.kpi_delta(kpis).collect()}
    assert got == {
        ("total_patients", "last_week"): (2.0, 25.0, "improved"), ("total_patients", "last_year"): (5.0, 100.0, "improved"),
        ("average_base_fee", "last_week"): (0.0, 0.0, "unchanged"), ("average_base_fee", "last_year"): (-5.0, -50.0, "improved"),
        ("married_rate", "last_week"): (0.0, 0.0, "unchanged"), ("married_rate", "last_year"): (0.0, 0.0, "unchanged"),
    }


def test_state_ranking_follows_sentiment(spark):
    df = spark.createDataFrame(
        [("total_patients", s, v) for s, v in (("A", 1.0), ("B", 3.0), ("C", 3.0))] + [("average_base_fee", s, v) for s, v in (("A", 1.0), ("B", 3.0))],
        "kpi_id string, geolocated_state string, value double",
    )
    got = {(r.kpi_id, r.geolocated_state): (r["rank"], r.min_value, r.max_value) for r in rs.state_ranking(df).collect()}
    assert got[("total_patients", "A")] == (3, 1.0, 3.0) and got[("total_patients", "C")][0] == 1
    assert got[("average_base_fee", "A")] == (1, 1.0, 3.0)


def test_pivots_fill_zero(spark):
    matrix = spark.createDataFrame([("drug", "MILD", 2), ("food", "N/A", 1), (None, "MILD", 9)], "allergen_nature string, severity string, count bigint")
    assert rows(rs.severity_by_nature(matrix), "allergen_nature") == [("drug", 2, 0, 0, 0), ("food", 0, 0, 0, 1), ("unknown", 9, 0, 0, 0)]
    odd = matrix.union(spark.createDataFrame([("drug", "FATAL", 3), ("food", None, 4)], matrix.schema))
    wide = rs.severity_by_nature(odd)
    assert wide.columns == ["allergen_nature", "MILD", "MODERATE", "SEVERE", "N/A", "FATAL", "unknown"]
    assert rows(wide, "allergen_nature") == [("drug", 2, 0, 0, 0, 3, 0), ("food", 0, 0, 0, 1, 0, 4), ("unknown", 9, 0, 0, 0, 0, 0)]
    trends = spark.createDataFrame([(2020, "food", 2), (0, "food", 1)], "year int, category string, count bigint")
    assert rows(rs.trends_by_category(trends)) == [(2020, 0, 2, 0)]
    hazard = spark.createDataFrame([(0, "Q0", "a", 0.5), (0, "Q0", "b", 0.25), (1, "Q1", "a", 0.1)], "bin bigint, label string, race string, hazard double")
    assert rows(rs.hazard_by_race(hazard, ["a", "b"]), "bin") == [(0, "Q0", 50.0, 25.0), (1, "Q1", 10.0, 0.0)]
    life = spark.createDataFrame([("M", 5, 0.9), ("F", 5, 0.8), ("M", 10, 0.7)], "gender string, age int, survival double")
    assert rows(rs.survival_curves(life), "age") == [(5, 90.0, 80.0), (10, 70.0, 0.0)]


def test_network_search_and_top_rows(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 2)], "item_a string, item_b string, transitions bigint")
    assert rows(rs.transition_nodes(edges), "node") == [("a", 3, 0), ("b", 2, 3), ("c", 0, 2)]
    found = rs.search_concepts(spark.createDataFrame([("Acute Bronchitis",), ("Asthma",)], "medical_concepts string"), "BRON")
    assert rows(found) == [("Acute Bronchitis",)]
    assert rows(rs.top_rows(edges, 1, "transitions")) == [("b", "c", 2)]


def test_as_of_is_a_parameter(spark, tables):
    later = geo.condition_kpis_by_state(tables.conditions, tables.patients, geo.us_states(spark), AS_OF + dt.timedelta(days=60))
    assert state(later, "Ohio")["chronic_condition_burden"] == 2
