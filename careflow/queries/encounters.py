from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from careflow.operators import encounters as en
from careflow.plans import snapshots
from careflow.plans.proxy import AS_OF, encounters, event_fees, with_views
from careflow.queries.registry import query
from careflow.sources import store

KPIS_SQL = """facts AS (
    SELECT q.period, e.* FROM encounters e JOIN periods q ON q.cur OR e.visit_start <= q.ref),
  load AS (
    SELECT period, avg(n) AS load FROM (SELECT period, practioner_id, count(*) AS n FROM facts GROUP BY 1, 2) GROUP BY period),
  encounter_kpis AS (
    SELECT f.period, count(*) AS total_visit_volume,
           round(sum(CAST(visting_total_fees AS DECIMAL(20, 6))), 2)::DOUBLE AS total_revenue_generated,
           round(avg((epoch(visit_end) - epoch(visit_start)) / 3600.0::DOUBLE), 2) AS average_encounter_duration_hours,
           round(avg(coalesce(visting_total_fees, 0.0::DOUBLE) - coalesce(coverage, 0.0::DOUBLE)), 2) AS average_patient_out_of_pocket,
           round(avg(coalesce(visiting_base_fees, 0.0::DOUBLE)), 2) AS average_base_fee,
           round(sum(CAST(coverage AS DECIMAL(20, 6))), 2)::DOUBLE AS total_covered_amount,
           count(DISTINCT uuid) AS unique_patients_seen,
           round(any_value(load), 2) AS average_practitioner_load
    FROM facts f JOIN load l ON l.period = f.period GROUP BY f.period)"""


@query("e_kpis_by_period", with_views(["encounters", "periods"], "SELECT * FROM encounter_kpis", KPIS_SQL))
def e_kpis_by_period(spark, sf_dir):
    return en.encounter_kpis(encounters(spark, sf_dir), AS_OF)


@query("e10_incremental_snapshots", with_views(["encounters", "periods"], "SELECT * FROM encounter_kpis", KPIS_SQL))
def e10_incremental_snapshots(spark, sf_dir):
    """The encounters in three batches, the second of them twice: all are read once, in one pass, the snapshots come from the state."""
    table = f"{store.scratch_database(spark, 'snapshots')}.encounters"
    rows = encounters(spark, sf_dir)
    early, urgent = F.col("visit_start") < F.lit(dt.datetime(1998, 1, 1)), F.col("encounter_type").startswith("1")
    batch = F.when(early, "early").when(~early & urgent, "urgent").otherwise("other")
    states = snapshots.encounter_state(rows.withColumn("batch", batch), by=["batch"])
    snapshots.add_batches(spark, table, states, ["early", "urgent", "urgent", "other"])
    return snapshots.encounter_snapshots(spark.table(table), AS_OF)


@query("e11_encounters_by_type", with_views(["encounters"], """
SELECT encounter_type, count(*) AS count FROM encounters GROUP BY encounter_type"""))
def e11_encounters_by_type(spark, sf_dir):
    return en.encounters_by_type(encounters(spark, sf_dir))


@query("e12_top_causes", with_views(["encounters"], """
SELECT encounter_reason, count(*) AS count FROM encounters GROUP BY encounter_reason
ORDER BY count DESC, encounter_reason LIMIT 10"""))
def e12_top_causes(spark, sf_dir):
    return en.top_causes(encounters(spark, sf_dir))


@query("e13_coverage_vs_oop_by_type", with_views(["encounters"], """
SELECT encounter_type, round(avg(coalesce(coverage, 0.0::DOUBLE)), 2) AS avg_covered,
       round(avg(coalesce(visting_total_fees, 0.0::DOUBLE) - coalesce(coverage, 0.0::DOUBLE)), 2) AS avg_out_of_pocket
FROM encounters GROUP BY encounter_type"""))
def e13_coverage_vs_oop_by_type(spark, sf_dir):
    return en.coverage_vs_oop_by_type(encounters(spark, sf_dir))


@query("e14_top_practitioners", with_views(["encounters"], """
SELECT practioner_id, count(*) AS count FROM encounters WHERE practioner_id IS NOT NULL GROUP BY practioner_id
ORDER BY count DESC, practioner_id LIMIT 10"""))
def e14_top_practitioners(spark, sf_dir):
    return en.top_practitioners(encounters(spark, sf_dir))


@query("e15_fee_divergence_by_type", with_views(["encounters"], """
SELECT encounter_type, round(avg(coalesce(visiting_base_fees, 0.0::DOUBLE)), 2) AS avg_base, round(avg(coalesce(visting_total_fees, 0.0::DOUBLE)), 2) AS avg_total
FROM encounters GROUP BY encounter_type"""))
def e15_fee_divergence_by_type(spark, sf_dir):
    return en.fee_divergence_by_type(encounters(spark, sf_dir))


@query("e16_most_expensive_causes", with_views(["encounters"], """
SELECT encounter_reason, round(avg(coalesce(visting_total_fees, 0.0::DOUBLE)), 2) AS avg_total FROM encounters GROUP BY encounter_reason
ORDER BY avg_total DESC, encounter_reason LIMIT 10"""))
def e16_most_expensive_causes(spark, sf_dir):
    return en.most_expensive_causes(encounters(spark, sf_dir))


def _anomaly_sql(view: str) -> str:
    return with_views([view], f"""
SELECT v.encounter_reason, count(*) AS anomaly_count
FROM filled v JOIN (SELECT encounter_reason, avg(visting_total_fees) AS m, stddev_samp(visting_total_fees) AS s
                    FROM filled GROUP BY encounter_reason) t ON t.encounter_reason = v.encounter_reason
WHERE s > 0 AND visting_total_fees > m + 2 * s GROUP BY v.encounter_reason""",
        f"filled AS (SELECT encounter_reason, coalesce(visting_total_fees, 0.0::DOUBLE) AS visting_total_fees FROM {view})")


@query("e17_high_cost_anomaly_index", _anomaly_sql("event_fees"))
def e17_high_cost_anomaly_index(spark, sf_dir):
    return en.high_cost_anomalies(event_fees(spark, sf_dir))


@query("e18_duration_by_type", with_views(["encounters"], """
SELECT encounter_type, round(avg((epoch(visit_end) - epoch(visit_start)) / 3600.0::DOUBLE), 2) AS avg_hours
FROM encounters GROUP BY encounter_type"""))
def e18_duration_by_type(spark, sf_dir):
    return en.duration_by_type(encounters(spark, sf_dir))


@query("e19_readmission_timeline", with_views(["encounters"], """
SELECT month_start, count(*) AS unique_patients, count(*) FILTER (visits > 1) AS repeat_patients,
       strftime(month_start, '%b %Y') AS label
FROM (SELECT CAST(date_trunc('month', visit_start) AS DATE) AS month_start, uuid, count(*) AS visits FROM encounters GROUP BY 1, 2)
GROUP BY month_start ORDER BY month_start DESC LIMIT 12"""))
def e19_readmission_timeline(spark, sf_dir):
    return en.readmission_timeline(encounters(spark, sf_dir))


@query("e20_uncovered_cost_trajectory", with_views(["encounters"], """
SELECT CAST(date_trunc('month', visit_start) AS DATE) AS month_start,
       round(avg(coalesce(visting_total_fees, 0.0::DOUBLE) - coalesce(coverage, 0.0::DOUBLE)), 2) AS avg_out_of_pocket,
       strftime(date_trunc('month', visit_start), '%b %Y') AS label
FROM encounters GROUP BY ALL ORDER BY month_start DESC LIMIT 12"""))
def e20_uncovered_cost_trajectory(spark, sf_dir):
    return en.uncovered_cost_trajectory(encounters(spark, sf_dir))
