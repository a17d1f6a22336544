from __future__ import annotations

from careflow.operators import patients as pa
from careflow.plans import snapshots
from careflow.plans.proxy import AS_OF, patients, with_views
from careflow.queries.registry import query
from careflow.sources import store

# age in whole years at death or at the as-of date
AGED = """aged AS (
  SELECT *, CAST(trunc((coalesce(death_date, DATE '2001-06-30') - birth_date) / 365.25::DOUBLE) AS INTEGER) AS age
  FROM patients)"""


def _kpis_sql(alive: str, age_day: str) -> str:
    return with_views(["patients", "periods"], """
SELECT period, count(*) AS total_patients,
       CAST(trunc(count(*) FILTER (alive)::DOUBLE / count(*) * 100) AS BIGINT) AS active_patient_rate,
       CAST(trunc(count(*) FILTER (gender = 'M')::DOUBLE / greatest(count(*) FILTER (gender = 'F'), 1) * 100) AS BIGINT) AS gender_balance_ratio,
       CAST(trunc(coalesce(avg(family_income) FILTER (alive), 0)) AS BIGINT) AS mean_family_income,
       CAST(coalesce(quantile_disc(family_income, 0.5) FILTER (alive), 0) AS BIGINT) AS median_family_income,
       round(coalesce(avg((age_day - birth_date) / 365.25::DOUBLE) FILTER (alive), 0), 1) AS avg_patient_age,
       round(count(*) FILTER (marital_status = 'M')::DOUBLE / count(*) * 100, 1) AS married_rate,
       round(count(*) FILTER (lower(doctorate) <> 'no doctorate')::DOUBLE / count(*) * 100, 1) AS higher_education_rate
FROM pop GROUP BY period""", f"""pop AS (
  SELECT q.period, p.*, {alive} AS alive, {age_day} AS age_day
  FROM patients p JOIN periods q
    ON q.cur OR (p.birth_date <= q.ref AND (p.death_date IS NULL OR p.death_date >= q.ref)))""")


@query("p_kpis_by_period", _kpis_sql("(death_date IS NULL OR (NOT cur AND death_date > ref))", "ref"))
def p_kpis_by_period(spark, sf_dir):
    return pa.patient_kpis(patients(spark, sf_dir), AS_OF)


@query("p9_kpis_with_recorded_status", _kpis_sql("(death_date IS NULL)", "DATE '2001-06-30'"))
def p9_kpis_with_recorded_status(spark, sf_dir):
    return pa.patient_kpis(patients(spark, sf_dir), AS_OF, status="recorded")


@query("p9_incremental_snapshots", _kpis_sql("(death_date IS NULL OR (NOT cur AND death_date > ref))", "ref"))
def p9_incremental_snapshots(spark, sf_dir):
    """The patients in two batches, the first of them twice."""
    table = f"{store.scratch_database(spark, 'snapshots')}.patients"
    rows = patients(spark, sf_dir)
    women = rows.where("gender = 'F'")
    for name, batch in (("women", women), ("women", women), ("others", rows.where("gender IS DISTINCT FROM 'F'"))):
        snapshots.add_batch(spark, table, name, snapshots.patient_state(batch))
    return snapshots.patient_snapshots(spark.table(table), AS_OF)


@query("p10_economic_dependence_ratio", with_views(["patients"], """
SELECT coalesce(CAST(trunc(count(*) FILTER (age < 20 OR age > 64)::DOUBLE
       / nullif(count(*) FILTER (age BETWEEN 20 AND 64), 0) * 100) AS BIGINT), 0) AS economic_dependence_ratio
FROM aged WHERE death_date IS NULL""", AGED))
def p10_economic_dependence_ratio(spark, sf_dir):
    return pa.economic_dependence_ratio(patients(spark, sf_dir), AS_OF)


@query("p11_cultural_diversity_score", with_views(["patients"], """
SELECT CAST(trunc((1.0::DOUBLE - sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)::DOUBLE)) * 100) AS BIGINT) AS cultural_diversity_score
FROM (SELECT race, count(*) AS n FROM patients WHERE death_date IS NULL GROUP BY race)"""))
def p11_cultural_diversity_score(spark, sf_dir):
    return pa.cultural_diversity_score(patients(spark, sf_dir))


@query("p12_mortality_rate", with_views(["patients"], """
SELECT round(count(death_date)::DOUBLE / count(*) * 100, 2) AS mortality_rate FROM patients"""))
def p12_mortality_rate(spark, sf_dir):
    return pa.mortality_rate(patients(spark, sf_dir))


@query("p13_age_wealth_correlation", with_views(["patients"], """
SELECT round(corr(age::DOUBLE, family_income::DOUBLE), 3) AS age_wealth_correlation FROM aged""", AGED))
def p13_age_wealth_correlation(spark, sf_dir):
    return pa.age_wealth_correlation(patients(spark, sf_dir), AS_OF)


def _gini_sql(rank: str) -> str:
    return with_views(["patients"], f"""
SELECT round(2.0::DOUBLE * sum(family_income::DOUBLE * r) / (sum(family_income)::DOUBLE * count(*))
             - (count(*) + 1)::DOUBLE / count(*), 3) AS income_inequality_index
FROM (SELECT family_income, {rank}() OVER (ORDER BY family_income) AS r FROM patients)""")


@query("p14_income_inequality_index", _gini_sql("row_number"))
def p14_income_inequality_index(spark, sf_dir):
    return pa.income_inequality_index(patients(spark, sf_dir))


@query("p14_income_inequality_dense_rank", _gini_sql("dense_rank"))
def p14_income_inequality_dense_rank(spark, sf_dir):
    return pa.income_inequality_index(patients(spark, sf_dir), rank_mode="dense")


YEARS = "years AS (SELECT CAST(y AS INTEGER) AS year, make_date(y, 12, 31) AS ref FROM range(1991, 2001) t(y))"

@query("p15_economic_dependence_trend", with_views(["patients"], """
SELECT year, CAST(trunc((count(uuid) - count(uuid) FILTER (age BETWEEN 20 AND 64))::DOUBLE
       / greatest(count(uuid) FILTER (age BETWEEN 20 AND 64), 1) * 100) AS BIGINT) AS economic_dependence
FROM (SELECT y.year, p.uuid, CAST(trunc((y.ref - birth_date) / 365.25::DOUBLE) AS INTEGER) AS age
      FROM years y LEFT JOIN patients p ON year(birth_date) <= y.year AND (death_date IS NULL OR year(death_date) > y.year))
GROUP BY year""", YEARS))
def p15_economic_dependence_trend(spark, sf_dir):
    return pa.economic_dependence_trend(patients(spark, sf_dir), AS_OF)


@query("p16_cultural_diversity_trend", with_views(["patients"], """
SELECT year, CAST(trunc((1.0::DOUBLE - sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)::DOUBLE)) * 100) AS BIGINT) AS cultural_diversity
FROM (SELECT y.year, race, count(*) AS n
      FROM years y JOIN patients p ON year(birth_date) <= y.year AND (death_date IS NULL OR year(death_date) > y.year)
      GROUP BY y.year, race)
GROUP BY year""", YEARS))
def p16_cultural_diversity_trend(spark, sf_dir):
    return pa.cultural_diversity_trend(patients(spark, sf_dir), AS_OF)


@query("p17_mortality_rate_trend", with_views(["patients"], """
SELECT y.year, round(count(*) FILTER (year(death_date) = y.year)::DOUBLE
       / greatest(count(*) FILTER (year(birth_date) <= y.year AND (death_date IS NULL OR year(death_date) >= y.year)), 1) * 100, 2) AS mortality_rate
FROM years y CROSS JOIN patients GROUP BY y.year""", YEARS))
def p17_mortality_rate_trend(spark, sf_dir):
    return pa.mortality_rate_trend(patients(spark, sf_dir), AS_OF)


def _survival_sql(exposed: str) -> str:
    return with_views(["patients"], """
SELECT gender, age, at_risk, deaths, survival FROM fold WHERE age > 0""", f"""{AGED},
  steps AS (
    SELECT gender, b.top, count(*) FILTER ({exposed}) AS at_risk,
           count(*) FILTER (age > b.top - 5 AND age <= b.top AND death_date IS NOT NULL) AS deaths
    FROM aged CROSS JOIN (SELECT CAST(t AS INTEGER) AS top FROM range(5, 90, 5) r(t)) b
    WHERE birth_date IS NOT NULL GROUP BY gender, b.top),
  fold AS (
    SELECT DISTINCT gender, 0 AS age, 0::BIGINT AS at_risk, 0::BIGINT AS deaths, 1.0::DOUBLE AS survival FROM steps
    UNION ALL
    SELECT s.gender, s.top, s.at_risk, s.deaths,
           round(f.survival * (1.0::DOUBLE - s.deaths::DOUBLE / greatest(s.at_risk, 1)), 3)
    FROM fold f JOIN steps s ON s.gender = f.gender AND s.top = f.age + 5)""")


@query("p18_survival_trend", _survival_sql("age > b.top - 5"))
def p18_survival_trend(spark, sf_dir):
    return pa.survival_trend(patients(spark, sf_dir), AS_OF)


@query("p18_survival_trend_reached_age", _survival_sql("age >= b.top"))
def p18_survival_trend_reached_age(spark, sf_dir):
    return pa.survival_trend(patients(spark, sf_dir), AS_OF, at_risk="end")


@query("p19_demographic_entropy", with_views(["patients"], """
SELECT geolocated_city, race, n,
       round(abs(-sum(n / total * log2(n / total)) OVER (PARTITION BY geolocated_city)), 3) AS demographic_entropy
FROM (SELECT geolocated_city, race, count(*) AS n,
             (sum(count(*)) OVER (PARTITION BY geolocated_city))::DOUBLE AS total
      FROM patients WHERE geolocated_city IS NOT NULL GROUP BY geolocated_city, race)"""))
def p19_demographic_entropy(spark, sf_dir):
    return pa.demographic_entropy(patients(spark, sf_dir))


@query("p20_wealth_trajectory", with_views(["patients"], """
SELECT band, CAST(CASE WHEN band > 0 THEN band * 5 + 1 ELSE 0 END AS VARCHAR) || '-' || CAST(band * 5 + 5 AS VARCHAR) AS age_band,
       CAST(trunc(coalesce(avg(family_income), 0)) AS BIGINT) AS avg_income,
       CAST(trunc(coalesce(avg(ceil(family_income::DOUBLE / nullif(age, 0))), 0)) AS BIGINT) AS avg_wealth_velocity
FROM (SELECT CAST(b AS INTEGER) AS band FROM range(0, 17) r(b))
LEFT JOIN aged ON age >= CASE WHEN band > 0 THEN band * 5 + 1 ELSE 0 END AND age <= band * 5 + 5
GROUP BY band""", AGED))
def p20_wealth_trajectory(spark, sf_dir):
    return pa.wealth_trajectory(patients(spark, sf_dir), AS_OF)


HAZARD_SQL = """bounds AS (
    SELECT max(family_income) AS hi, min(family_income) AS lo,
           CASE WHEN max(family_income) > min(family_income)
                THEN CAST(ceil((max(family_income) - min(family_income)) / 10.0::DOUBLE) AS BIGINT) ELSE 1000 END AS width
    FROM patients),
  hazard AS (
    SELECT race, bin, 'Q' || CAST(bin AS VARCHAR) AS label, low, high, count(uuid) AS n, count(death_date) AS deaths,
           round(count(death_date)::DOUBLE / greatest(count(uuid), 1), 3) AS hazard
    FROM (SELECT race, b AS bin, CASE WHEN b = 0 THEN 0 ELSE b * width + 1 END AS low, (b + 1) * width AS high
          FROM (SELECT race, width, unnest(range(CASE WHEN lo = 0 THEN 0 ELSE CAST(floor((lo - 1) / width::DOUBLE) AS BIGINT) END, hi // width + 1)) AS b
                FROM (SELECT DISTINCT race FROM patients WHERE race <> 'other'), bounds)) s
    LEFT JOIN (SELECT race AS r2, uuid, death_date, family_income FROM patients) ON r2 = race AND family_income BETWEEN low AND high
    GROUP BY race, bin, low, high)"""


@query("p21_mortality_hazard", with_views(["patients"], "SELECT * FROM hazard", HAZARD_SQL))
def p21_mortality_hazard(spark, sf_dir):
    return pa.mortality_hazard(patients(spark, sf_dir))
