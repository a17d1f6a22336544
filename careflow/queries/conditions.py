from __future__ import annotations

from careflow.operators import conditions as co
from careflow.plans import snapshots
from careflow.plans.proxy import AS_OF, conditions, patients, with_views
from careflow.queries.registry import query
from careflow.sources import store

KPIS_SQL = """facts AS (
    SELECT q.period, q.ref, q.cur, c.*,
           date_of_abetment IS NOT NULL AND (q.cur OR date_of_abetment <= q.ref) AS cured
    FROM conditions c JOIN periods q ON q.cur OR c.condition_record_date <= q.ref),
  complexity AS (
    SELECT period, CAST(ceil(avg(k)) AS BIGINT) AS score
    FROM (SELECT period, uuid, count(DISTINCT medical_concepts) AS k FROM facts WHERE cured GROUP BY period, uuid)
    GROUP BY period),
  condition_kpis AS (
    SELECT f.period,
           count(*) FILTER (NOT cured) AS current_active_burden,
           round(count(*) FILTER (cured)::DOUBLE / count(*) * 100, 2) AS global_recovery_rate,
           coalesce(any_value(score), 0) AS patient_complexity_score,
           CAST(ceil(coalesce(avg(date_of_abetment - condition_record_date) FILTER (cured), 0)) AS BIGINT) AS average_time_to_cure,
           count(*) FILTER (condition_record_date >= ref - 30) AS admission_rate_last_30_days,
           count(*) AS total_diagnoses,
           count(DISTINCT medical_concepts) AS unique_conditions,
           count(*) FILTER (NOT cured AND ref - condition_record_date >= 90) AS chronic_condition_burden
    FROM facts f LEFT JOIN complexity x ON x.period = f.period GROUP BY f.period)"""


@query("c_kpis_by_period", with_views(["conditions", "periods"], "SELECT * FROM condition_kpis", KPIS_SQL))
def c_kpis_by_period(spark, sf_dir):
    return co.condition_kpis(conditions(spark, sf_dir), AS_OF)


@query("c9_incremental_snapshots", with_views(["conditions", "periods"], "SELECT * FROM condition_kpis", KPIS_SQL))
def c9_incremental_snapshots(spark, sf_dir):
    """The conditions in two batches, the first of them twice."""
    table = f"{store.scratch_database(spark, 'snapshots')}.conditions"
    rows = conditions(spark, sf_dir)
    open_ones = rows.where("date_of_abetment IS NULL")
    for name, batch in (("open", open_ones), ("open", open_ones), ("closed", rows.where("date_of_abetment IS NOT NULL"))):
        snapshots.add_batch(spark, table, name, snapshots.condition_state(batch))
    return snapshots.condition_snapshots(spark.table(table), AS_OF)


@query("c10_top_disorder_conditions", with_views(["conditions"], """
SELECT medical_concepts, count(*) AS open_count FROM conditions
WHERE associated_semantics = 'disorder' AND date_of_abetment IS NULL
GROUP BY medical_concepts ORDER BY open_count DESC, medical_concepts LIMIT 10"""))
def c10_top_disorder_conditions(spark, sf_dir):
    return co.top_disorder_conditions(conditions(spark, sf_dir))


@query("c11_chronic_vs_acute", with_views(["conditions"], """
SELECT CASE WHEN coalesce(date_of_abetment, DATE '2001-06-30') - condition_record_date >= 90 THEN 'chronic' ELSE 'acute' END AS clinical_course,
       count(uuid) AS count
FROM conditions WHERE associated_semantics = 'disorder' GROUP BY 1"""))
def c11_chronic_vs_acute(spark, sf_dir):
    return co.chronic_vs_acute(conditions(spark, sf_dir), AS_OF)


@query("c12_disease_resolution_efficiency", with_views(["conditions"], """
SELECT medical_concepts, count(uuid) AS frequency,
       CAST(floor(avg(date_of_abetment - condition_record_date)) AS BIGINT) AS avg_time_to_cure
FROM conditions WHERE associated_semantics = 'disorder' AND date_of_abetment IS NOT NULL
GROUP BY medical_concepts ORDER BY avg_time_to_cure, frequency DESC, medical_concepts LIMIT 20"""))
def c12_disease_resolution_efficiency(spark, sf_dir):
    return co.disease_resolution_efficiency(conditions(spark, sf_dir))


@query("c13_recurring_disorders", with_views(["conditions"], """
SELECT medical_concepts, count(*) AS recurring_patients
FROM (SELECT uuid, medical_concepts FROM conditions WHERE associated_semantics = 'disorder'
      GROUP BY uuid, medical_concepts HAVING count(*) > 1)
GROUP BY medical_concepts ORDER BY recurring_patients DESC, medical_concepts LIMIT 10"""))
def c13_recurring_disorders(spark, sf_dir):
    return co.recurring_disorders(conditions(spark, sf_dir))


@query("c14_comorbidity_pattern", with_views(["conditions"], """
SELECT open_disorders, count(*) AS patients
FROM (SELECT uuid, count(medical_concepts) AS open_disorders FROM conditions
      WHERE associated_semantics = 'disorder' AND date_of_abetment IS NULL GROUP BY uuid)
GROUP BY open_disorders"""))
def c14_comorbidity_pattern(spark, sf_dir):
    return co.comorbidity_pattern(conditions(spark, sf_dir))


@query("c15_clinical_gravity", with_views(["conditions"], """
SELECT medical_concepts, count(DISTINCT o.uuid) AS patients, round(avg(load - 1), 0) AS score
FROM open_rows o JOIN (SELECT uuid, count(DISTINCT medical_concepts) AS load FROM open_rows GROUP BY uuid) l ON l.uuid = o.uuid
GROUP BY medical_concepts ORDER BY score DESC, medical_concepts LIMIT 15""",
    "open_rows AS (SELECT * FROM conditions WHERE date_of_abetment IS NULL)"))
def c15_clinical_gravity(spark, sf_dir):
    return co.clinical_gravity(conditions(spark, sf_dir))


INCIDENCE_SQL = """top AS (
    SELECT medical_concepts FROM conditions GROUP BY medical_concepts ORDER BY count(*) DESC, medical_concepts LIMIT 15),
  incidence AS (
    SELECT medical_concepts, CAST(month(condition_record_date) AS INTEGER) AS month_number,
           strftime(make_date(2000, month(condition_record_date), 1), '%b') AS month, count(*) AS count
    FROM conditions WHERE medical_concepts IN (SELECT medical_concepts FROM top)
    GROUP BY medical_concepts, month(condition_record_date))"""
ALL_INCIDENCE_SQL = INCIDENCE_SQL.replace("SELECT medical_concepts FROM conditions GROUP BY medical_concepts ORDER BY count(*) DESC, medical_concepts LIMIT 15", "SELECT DISTINCT medical_concepts FROM conditions")


@query("c16_incidence_velocity", with_views(["conditions"], "SELECT * FROM incidence", INCIDENCE_SQL))
def c16_incidence_velocity(spark, sf_dir):
    return co.incidence_velocity(conditions(spark, sf_dir))


PAIRS_SQL = """items AS (SELECT DISTINCT uuid, medical_concepts FROM conditions),
  pairs AS (
    SELECT a.medical_concepts AS item_a, b.medical_concepts AS item_b, count(*) AS patients
    FROM items a JOIN items b ON a.uuid = b.uuid AND a.medical_concepts < b.medical_concepts
    GROUP BY 1, 2 ORDER BY patients DESC, item_a, item_b LIMIT 50)"""


@query("c17_concept_cooccurrence", with_views(["conditions"], "SELECT * FROM pairs", PAIRS_SQL))
def c17_concept_cooccurrence(spark, sf_dir):
    return co.concept_cooccurrence(conditions(spark, sf_dir))


TRANSITIONS_SQL = """days AS (SELECT DISTINCT uuid, medical_concepts, condition_record_date AS d FROM conditions),
  counted AS (
    SELECT a.medical_concepts AS item_a, b.medical_concepts AS item_b, count(*) AS transitions
    FROM days a JOIN days b ON a.uuid = b.uuid AND a.medical_concepts <> b.medical_concepts AND b.d > a.d AND b.d - a.d <= 365
    GROUP BY 1, 2),
  transitions AS (
    SELECT item_a, item_b, transitions, CAST(sum(transitions) OVER (PARTITION BY item_a) AS BIGINT) AS total_from_a,
           round(transitions::DOUBLE / sum(transitions) OVER (PARTITION BY item_a), 2) AS probability
    FROM counted ORDER BY transitions DESC, item_a, item_b LIMIT 50)"""
ALL_TRANSITIONS_SQL = TRANSITIONS_SQL.replace(" ORDER BY transitions DESC, item_a, item_b LIMIT 50", "")


@query("c18_disease_transition_patterns", with_views(["conditions"], "SELECT * FROM transitions", TRANSITIONS_SQL))
def c18_disease_transition_patterns(spark, sf_dir):
    return co.disease_transitions(conditions(spark, sf_dir))


def gap_sql(order: str, k: int) -> str:
    return with_views(["conditions"], f"""
SELECT medical_concepts, CAST(trunc(avg(gap)) AS BIGINT) AS avg_gap_days
FROM (SELECT medical_concepts, condition_record_date - lag(date_of_abetment) OVER (
             PARTITION BY uuid, medical_concepts ORDER BY condition_record_date, date_of_abetment NULLS LAST) AS gap
      FROM conditions)
WHERE gap > 0 GROUP BY medical_concepts ORDER BY {order}, medical_concepts LIMIT {k}""")


@query("c19_average_condition_recurrence_gap", gap_sql("avg(gap) DESC", 10))
def c19_average_condition_recurrence_gap(spark, sf_dir):
    return co.recurrence_gap(conditions(spark, sf_dir))


@query("c20_age_based_burden", with_views(["conditions", "patients"], """
SELECT CAST(floor(age / 10) * 10 AS BIGINT) AS age_from,
       CAST(CAST(floor(age / 10) * 10 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(age / 10) * 10 + 9 AS BIGINT) AS VARCHAR) AS age_group,
       count(*) AS count
FROM (SELECT floor((condition_record_date - birth_date) / 365.25::DOUBLE) AS age
      FROM conditions c JOIN patients p ON p.uuid = c.uuid)
WHERE age >= 0 AND age < 120 GROUP BY 1, 2"""))
def c20_age_based_burden(spark, sf_dir):
    return co.age_based_burden(conditions(spark, sf_dir), patients(spark, sf_dir))


@query("c21_average_open_conditions", with_views(["conditions"], """
SELECT CAST(ceil(avg(n)) AS BIGINT) AS avg_open_conditions
FROM (SELECT uuid, count(*) AS n FROM conditions WHERE date_of_abetment IS NULL GROUP BY uuid)"""))
def c21_average_open_conditions(spark, sf_dir):
    return co.average_open_conditions(conditions(spark, sf_dir))
