from __future__ import annotations

from pyspark.sql import functions as F

from careflow.operators import geo
from careflow.plans import proxy
from careflow.plans.proxy import AS_OF, with_views
from careflow.queries.registry import query

PATIENTS_SQL = """by_state AS (
    SELECT s.geolocated_state, count(uuid) AS total_patients,
           CAST(trunc(coalesce(count(uuid) FILTER (death_date IS NULL)::DOUBLE / nullif(count(uuid), 0), 0) * 100) AS BIGINT) AS active_patient_rate,
           CAST(trunc(count(*) FILTER (gender = 'M')::DOUBLE / greatest(count(*) FILTER (gender = 'F'), 1) * 100) AS BIGINT) AS gender_balance_ratio,
           CAST(trunc(coalesce(avg(family_income) FILTER (death_date IS NULL), 0)) AS BIGINT) AS mean_family_income,
           CAST(trunc(coalesce(median(family_income) FILTER (death_date IS NULL), 0)) AS BIGINT) AS median_family_income,
           round(coalesce(avg(coalesce((DATE '2001-06-30' - birth_date) / 365.25::DOUBLE, 0)) FILTER (uuid IS NOT NULL AND death_date IS NULL), 0), 1) AS avg_patient_age,
           round(coalesce(count(*) FILTER (marital_status = 'M')::DOUBLE / nullif(count(uuid), 0), 0) * 100, 1) AS married_rate,
           round(coalesce(count(*) FILTER (doctorate <> 'No doctorate')::DOUBLE / nullif(count(uuid), 0), 0) * 100, 1) AS higher_education_rate
    FROM states s LEFT JOIN patients p ON p.geolocated_state = s.geolocated_state GROUP BY s.geolocated_state)"""


@query("g5_patient_kpis_by_state", with_views(["patients", "states"], "SELECT * FROM by_state", PATIENTS_SQL))
def g5_patient_kpis_by_state(spark, sf_dir):
    return geo.patient_kpis_by_state(proxy.patients(spark, sf_dir), proxy.states(spark, sf_dir), AS_OF)


CONDITIONS_SQL = """located AS (
    SELECT c.*, p.geolocated_state FROM conditions c JOIN patients p ON p.uuid = c.uuid),
  complexity AS (
    SELECT geolocated_state, CAST(ceil(avg(k)) AS BIGINT) AS score
    FROM (SELECT geolocated_state, uuid, count(DISTINCT medical_concepts) AS k FROM located WHERE date_of_abetment IS NOT NULL GROUP BY 1, 2)
    GROUP BY 1),
  by_state AS (
    SELECT s.geolocated_state,
           count(l.uuid) FILTER (date_of_abetment IS NULL) AS current_active_burden,
           round(coalesce(count(date_of_abetment)::DOUBLE / nullif(count(l.uuid), 0), 0) * 100, 1) AS global_recovery_rate,
           coalesce(any_value(score), 0) AS patient_complexity_score,
           CAST(ceil(coalesce(avg(date_of_abetment - condition_record_date), 0)) AS BIGINT) AS average_time_to_cure,
           count(*) FILTER (condition_record_date >= DATE '2001-06-30' - 30) AS admission_rate_last_30_days,
           count(l.uuid) AS total_diagnoses,
           count(DISTINCT medical_concepts) AS unique_conditions,
           count(*) FILTER (date_of_abetment IS NULL AND DATE '2001-06-30' - condition_record_date >= 90) AS chronic_condition_burden
    FROM states s LEFT JOIN located l ON l.geolocated_state = s.geolocated_state
    LEFT JOIN complexity x ON x.geolocated_state = s.geolocated_state GROUP BY s.geolocated_state)"""


@query("g6_condition_kpis_by_state", with_views(["conditions", "patients", "states"], "SELECT * FROM by_state", CONDITIONS_SQL))
def g6_condition_kpis_by_state(spark, sf_dir):
    t = proxy.tables(spark, sf_dir, "conditions", "patients")
    return geo.condition_kpis_by_state(t.conditions, t.patients, proxy.states(spark, sf_dir), AS_OF)


ENCOUNTERS_SQL = """located AS (
    SELECT e.*, p.geolocated_state FROM encounters e JOIN patients p ON p.uuid = e.uuid),
  load AS (
    SELECT geolocated_state, round(avg(n), 2) AS load
    FROM (SELECT geolocated_state, practioner_id, count(*) AS n FROM located WHERE practioner_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  by_state AS (
    SELECT s.geolocated_state, count(l.uuid) AS total_visit_volume,
           round(coalesce(sum(CAST(visting_total_fees AS DECIMAL(20, 6))), 0), 2)::DOUBLE AS total_revenue_generated,
           round(coalesce(avg((epoch(visit_end) - epoch(visit_start)) / 3600.0::DOUBLE), 0), 2) AS average_encounter_duration_hours,
           round(coalesce(avg(greatest(0.0::DOUBLE, visting_total_fees - coalesce(coverage, 0.0::DOUBLE))) FILTER (l.uuid IS NOT NULL), 0), 2) AS average_patient_out_of_pocket,
           round(coalesce(avg(visiting_base_fees), 0), 2) AS average_base_fee,
           round(coalesce(sum(CAST(coverage AS DECIMAL(20, 6))), 0), 2)::DOUBLE AS total_covered_amount,
           count(DISTINCT l.uuid) AS unique_patients_seen,
           coalesce(any_value(load), 0) AS average_practitioner_load,
           count(*) FILTER (CAST(visit_start AS DATE) >= DATE '2001-06-30' - 30) AS encounters_30d
    FROM states s LEFT JOIN located l ON l.geolocated_state = s.geolocated_state
    LEFT JOIN load x ON x.geolocated_state = s.geolocated_state GROUP BY s.geolocated_state)"""


@query("g7_encounter_kpis_by_state", with_views(["encounters", "patients", "states"], "SELECT * FROM by_state", ENCOUNTERS_SQL))
def g7_encounter_kpis_by_state(spark, sf_dir):
    t = proxy.tables(spark, sf_dir, "encounters", "patients")
    return geo.encounter_kpis_by_state(t.encounters, t.patients, proxy.states(spark, sf_dir), AS_OF)


ALLERGIES_SQL = """located AS (
    SELECT a.*, p.geolocated_state FROM allergies a JOIN patients p ON p.uuid = a.uuid),
  people AS (SELECT geolocated_state, count(*) AS n FROM patients GROUP BY 1),
  poly AS (
    SELECT geolocated_state, count(*) FILTER (k >= 2) AS n
    FROM (SELECT geolocated_state, uuid, count(DISTINCT allergy_code) AS k FROM located GROUP BY 1, 2) GROUP BY 1),
  visits AS (
    SELECT uuid, CAST(visit_start AS DATE) - lag(CAST(visit_start AS DATE)) OVER (PARTITION BY uuid ORDER BY visit_start) AS gap FROM encounters),
  back AS (
    SELECT geolocated_state, count(DISTINCT uuid) AS n FROM located
    WHERE uuid IN (SELECT uuid FROM visits WHERE gap > 0 AND gap <= 30) GROUP BY 1),
  by_state AS (
    SELECT s.geolocated_state, count(DISTINCT l.uuid) AS total_allergic_population,
           round(coalesce(count(l.uuid) FILTER (allergy_cure_date IS NULL)::DOUBLE / nullif(count(l.uuid), 0), 0) * 100, 2) AS active_allergy_percentage,
           round(coalesce(count(*) FILTER (primary_symptom_severity = 'SEVERE')::DOUBLE / nullif(count(l.uuid), 0), 0) * 100, 2) AS severe_allergy_incidence_rate,
           round(coalesce(count(DISTINCT l.uuid)::DOUBLE / any_value(people.n), 0) * 100, 2) AS allergic_patient_rate,
           round(coalesce(count(*) FILTER (regexp_matches(allergy_description, '^[pP]enicillin$') AND primary_symptom_severity <> 'SEVERE'
                          AND secondary_symptom_severity <> 'SEVERE' AND primary_symptom_description <> 'Anaphylaxis')::DOUBLE
                    / nullif(count(*) FILTER (regexp_matches(allergy_description, '^[pP]enicillin$')), 0), 0) * 100, 2) AS penicillin_allergy_delabeling_eligibility_rate,
           round(coalesce(any_value(back.n)::DOUBLE / nullif(count(DISTINCT l.uuid), 0), 0) * 100, 2) AS allergy_related_readmission_rate,
           round(coalesce(any_value(poly.n)::DOUBLE / nullif(count(DISTINCT l.uuid), 0), 0) * 100, 2) AS poly_allergen_patient_rate,
           round(coalesce(count(DISTINCT CASE WHEN category = 'medication' OR allergen_nature = 'drug' THEN l.uuid END)::DOUBLE
                 / nullif(count(DISTINCT l.uuid), 0), 0) * 100, 2) AS drug_hypersensitivity_rate
    FROM states s LEFT JOIN located l ON l.geolocated_state = s.geolocated_state
    LEFT JOIN people ON people.geolocated_state = s.geolocated_state
    LEFT JOIN poly ON poly.geolocated_state = s.geolocated_state
    LEFT JOIN back ON back.geolocated_state = s.geolocated_state
    GROUP BY s.geolocated_state)"""


@query("g8_allergy_kpis_by_state", with_views(["allergies", "encounters", "patients", "states"], "SELECT * FROM by_state", ALLERGIES_SQL))
def g8_allergy_kpis_by_state(spark, sf_dir):
    t = proxy.tables(spark, sf_dir, "allergies", "encounters", "patients")
    return geo.allergy_kpis_by_state(t.allergies, t.patients, t.encounters, proxy.states(spark, sf_dir))


@query("g1_state_kpi_by_id", with_views(["encounters", "patients", "states"], """
SELECT geolocated_state, 'avg_out_of_pocket' AS kpi_id, average_patient_out_of_pocket AS value,
       0.0::DOUBLE AS trend, FALSE AS is_simulated
FROM by_state""", ENCOUNTERS_SQL))
def g1_state_kpi_by_id(spark, sf_dir):
    return geo.state_kpi("avg_out_of_pocket", proxy.tables(spark, sf_dir, "encounters", "patients"), proxy.states(spark, sf_dir), AS_OF)


@query("g2_conditions_with_state", with_views(["conditions", "patients"], """
SELECT geolocated_state, count(*) AS patients, CAST(sum(n) AS BIGINT) AS rows
FROM (SELECT uuid, count(*) AS n FROM conditions GROUP BY uuid) c JOIN patients p ON p.uuid = c.uuid
WHERE geolocated_state IS NOT NULL GROUP BY geolocated_state"""))
def g2_conditions_with_state(spark, sf_dir):
    per_patient = proxy.conditions(spark, sf_dir).groupBy("uuid").agg(F.count(F.lit(1)).alias("n"))
    located = geo.attach_state(per_patient, proxy.patients(spark, sf_dir))
    return located.groupBy(geo.STATE).agg(F.count(F.lit(1)).alias("patients"), F.sum("n").alias("rows"))


@query("g4_state_scaffold", with_views(["patients", "states"], """
SELECT s.geolocated_state, count(uuid) AS value
FROM states s LEFT JOIN patients p ON p.geolocated_state = s.geolocated_state AND p.birth_date < DATE '1911-01-01'
GROUP BY s.geolocated_state"""))
def g4_state_scaffold(spark, sf_dir):
    old = geo.with_state(proxy.patients(spark, sf_dir)).where(F.col("birth_date") < F.lit("1911-01-01").cast("date"))
    counts = old.groupBy(geo.STATE).agg(F.count(F.lit(1)).alias("n"))
    return geo.scaffold(proxy.states(spark, sf_dir), counts, values=[F.col("n").alias("value")])
