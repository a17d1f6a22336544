from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from careflow.operators import allergies as al
from careflow.plans import snapshots
from careflow.plans.proxy import AS_OF, allergies, encounters, patients, with_views
from careflow.queries.registry import query
from careflow.sources import store

KPIS_SQL = """facts AS (
    SELECT q.period, q.ref, q.cur, a.* FROM allergies a JOIN periods q ON q.cur OR a.allergy_detection_date <= q.ref),
  everyone AS (
    SELECT q.period, count(*) AS n FROM patients p
    JOIN periods q ON q.cur OR (birth_date <= ref AND (death_date IS NULL OR death_date >= ref)) GROUP BY q.period),
  poly AS (
    SELECT period, count(*) AS n FROM (
      SELECT period, uuid FROM facts GROUP BY period, uuid HAVING count(DISTINCT allergy_code) >= 2) GROUP BY period),
  visits AS (
    SELECT q.period, e.uuid, CAST(visit_start AS DATE) AS d,
           lag(CAST(visit_start AS DATE)) OVER (PARTITION BY q.period, e.uuid ORDER BY visit_start) AS prev
    FROM encounters e JOIN periods q ON q.cur OR CAST(visit_start AS DATE) <= q.ref
    WHERE EXISTS (SELECT 1 FROM facts f WHERE f.period = q.period AND f.uuid = e.uuid)),
  back AS (SELECT period, count(DISTINCT uuid) AS n FROM visits WHERE d - prev > 0 AND d - prev <= 30 GROUP BY period),
  allergy_kpis AS (
    SELECT f.period, count(DISTINCT uuid) AS total_allergic_population,
           round(count(*) FILTER (allergy_cure_date IS NULL OR (NOT cur AND allergy_cure_date > ref))::DOUBLE / count(*) * 100, 2) AS active_allergy_percentage,
           round(count(*) FILTER (primary_symptom_severity = 'SEVERE')::DOUBLE / count(*) * 100, 2) AS severe_allergy_incidence_rate,
           round(count(DISTINCT uuid)::DOUBLE / any_value(everyone.n) * 100, 2) AS allergic_patient_rate,
           coalesce(round(count(*) FILTER (regexp_matches(allergy_description, '^[pP]enicillin$') AND primary_symptom_severity <> 'SEVERE'
                          AND secondary_symptom_severity <> 'SEVERE' AND primary_symptom_description <> 'Anaphylaxis')::DOUBLE
                    / nullif(count(*) FILTER (regexp_matches(allergy_description, '^[pP]enicillin$')), 0) * 100, 2), 0) AS penicillin_allergy_delabeling_eligibility_rate,
           round(coalesce(any_value(back.n), 0)::DOUBLE / count(DISTINCT uuid) * 100, 2) AS allergy_related_readmission_rate,
           round(coalesce(any_value(poly.n), 0)::DOUBLE / count(DISTINCT uuid) * 100, 2) AS poly_allergen_patient_rate,
           round(count(DISTINCT CASE WHEN category = 'medication' OR allergen_nature = 'drug' THEN uuid END)::DOUBLE / count(DISTINCT uuid) * 100, 2) AS drug_hypersensitivity_rate
    FROM facts f JOIN everyone ON everyone.period = f.period
    LEFT JOIN poly ON poly.period = f.period LEFT JOIN back ON back.period = f.period
    GROUP BY f.period)"""


@query("a_kpis_by_period", with_views(["allergies", "patients", "encounters", "periods"], "SELECT * FROM allergy_kpis", KPIS_SQL))
def a_kpis_by_period(spark, sf_dir):
    return al.allergy_kpis(allergies(spark, sf_dir), patients(spark, sf_dir), encounters(spark, sf_dir), AS_OF)


@query("a10_incremental_snapshots", with_views(["allergies", "patients", "encounters", "periods"], "SELECT * FROM allergy_kpis", KPIS_SQL))
def a10_incremental_snapshots(spark, sf_dir):
    """Allergies, patients and encounters in two batches each, the first of them twice; the states of both are made in one pass."""
    table = f"{store.scratch_database(spark, 'snapshots')}.allergies"
    a, p, e = allergies(spark, sf_dir), patients(spark, sf_dir), encounters(spark, sf_dir)
    early = F.col("visit_start") < F.lit(dt.datetime(1998, 1, 1))
    named = lambda df, is_first: df.withColumn("batch", F.when(is_first, "first").otherwise("rest"))
    path = store.scratch_path(spark, "allergies")
    named(a, F.col("category") == "food").drop("encounter_id").write.parquet(path)  # as the state reads them twice
    states = snapshots.allergy_state(spark.read.parquet(path), named(p, F.col("gender") == "F"), named(e, early), by=["batch"])
    snapshots.add_batches(spark, table, states, ["first", "first", "rest"])
    return snapshots.allergy_snapshots(spark.table(table), AS_OF)


@query("a9_allergy_risk_stratification", with_views(["allergies"], """
SELECT coalesce(allergen_nature, 'Unknown') AS allergen_nature, count(DISTINCT uuid) AS patients,
       round(count(DISTINCT uuid)::DOUBLE / (SELECT count(DISTINCT uuid) FROM allergies) * 100, 2) AS share
FROM allergies GROUP BY allergen_nature"""))
def a9_allergy_risk_stratification(spark, sf_dir):
    return al.allergy_risk_stratification(allergies(spark, sf_dir))


@query("a11_top_causative_agents", with_views(["allergies"], """
SELECT allergy_description, count(*) AS count FROM allergies GROUP BY allergy_description
ORDER BY count DESC, allergy_description LIMIT 10"""))
def a11_top_causative_agents(spark, sf_dir):
    return al.top_causative_agents(allergies(spark, sf_dir))


@query("a12_severity_distribution", with_views(["allergies"], """
SELECT primary_symptom_severity, count(*) AS count FROM allergies GROUP BY primary_symptom_severity"""))
def a12_severity_distribution(spark, sf_dir):
    return al.severity_distribution(allergies(spark, sf_dir))


DISCOVERY_SQL = """discovery AS (
    SELECT CAST(coalesce(year(allergy_detection_date), 0) AS INTEGER) AS year, category, count(*) AS count
    FROM allergies GROUP BY 1, 2)"""


@query("a13_discovery_trends", with_views(["allergies"], "SELECT * FROM discovery", DISCOVERY_SQL))
def a13_discovery_trends(spark, sf_dir):
    return al.discovery_trends(allergies(spark, sf_dir))


@query("a14_category_distribution", with_views(["allergies"], """
SELECT category, count(*) AS count FROM allergies GROUP BY category"""))
def a14_category_distribution(spark, sf_dir):
    return al.category_distribution(allergies(spark, sf_dir))


@query("a15_cross_reactivity_risk_matrix", with_views(["allergies"], """
SELECT a.allergy_description AS item_a, b.allergy_description AS item_b, count(*) AS co_occurrence_count
FROM allergies a JOIN allergies b ON a.uuid = b.uuid AND a.allergy_description < b.allergy_description
GROUP BY 1, 2 ORDER BY co_occurrence_count DESC, item_a, item_b LIMIT 20"""))
def a15_cross_reactivity_risk_matrix(spark, sf_dir):
    return al.cross_reactivity(allergies(spark, sf_dir))


MATRIX_SQL = """matrix AS (
    SELECT allergen_nature, primary_symptom_severity AS severity, count(*) AS count FROM allergies GROUP BY 1, 2)"""


@query("a16_nature_severity_matrix", with_views(["allergies"], "SELECT * FROM matrix", MATRIX_SQL))
def a16_nature_severity_matrix(spark, sf_dir):
    return al.nature_severity_matrix(allergies(spark, sf_dir))


@query("a17_age_at_onset_distribution", with_views(["allergies", "patients"], """
SELECT CAST(floor(age / 10) * 10 AS BIGINT) AS age_from,
       CAST(CAST(floor(age / 10) * 10 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(age / 10) * 10 + 9 AS BIGINT) AS VARCHAR) AS age_group,
       count(*) AS count
FROM (SELECT (allergy_detection_date - birth_date) / 365.25::DOUBLE AS age FROM allergies a JOIN patients p ON p.uuid = a.uuid)
WHERE age IS NOT NULL GROUP BY 1, 2"""))
def a17_age_at_onset_distribution(spark, sf_dir):
    return al.age_at_onset(allergies(spark, sf_dir), patients(spark, sf_dir))


@query("a18_pollen_seasonality_acceleration", with_views(["allergies"], """
SELECT CAST(m AS INTEGER) AS month_number, strftime(make_date(2000, m, 1), '%b') AS month, n AS count,
       coalesce(round((n - prev)::DOUBLE / prev * 100, 2), 0.0::DOUBLE) AS mom_growth_rate
FROM (SELECT m, n, lag(n) OVER (ORDER BY m) AS prev
      FROM (SELECT month(allergy_detection_date) AS m, count(*) AS n FROM allergies
            WHERE category = 'environment' OR allergen_nature = 'environment' GROUP BY 1))"""))
def a18_pollen_seasonality_acceleration(spark, sf_dir):
    return al.pollen_seasonality(allergies(spark, sf_dir))
