from __future__ import annotations

from pyspark.sql import functions as F

from careflow.operators import allergies as al
from careflow.operators import conditions as co
from careflow.operators import encounters as en
from careflow.operators import geo, patients as pa, reshape as rs
from careflow.plans import proxy
from careflow.plans.proxy import AS_OF, with_views
from careflow.queries import allergies as qa
from careflow.queries import conditions as qc
from careflow.queries import encounters as qe
from careflow.queries import geo as qg
from careflow.queries import patients as qp
from careflow.queries.registry import ORACLES, query

RACES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("r1_survival_curves", f"""
SELECT age, round(coalesce(max(survival) FILTER (gender = 'M'), 0) * 100, 1) AS male,
       round(coalesce(max(survival) FILTER (gender = 'F'), 0) * 100, 1) AS female
FROM ({ORACLES["p18_survival_trend"]}) GROUP BY age""")
def r1_survival_curves(spark, sf_dir):
    return rs.survival_curves(pa.survival_trend(proxy.patients(spark, sf_dir), AS_OF))


@query("r2_hazard_by_race", with_views(["patients"], "SELECT bin, label, " + ", ".join(
    f"round(coalesce(max(hazard) FILTER (race = '{r}'), 0) * 100, 1) AS \"{r}\"" for r in RACES
) + " FROM hazard GROUP BY bin, label", qp.HAZARD_SQL))
def r2_hazard_by_race(spark, sf_dir):
    return rs.hazard_by_race(pa.mortality_hazard(proxy.patients(spark, sf_dir)), RACES)


@query("r3_discovery_trends_by_category", with_views(["allergies"], """
SELECT year, CAST(coalesce(sum(count) FILTER (category = 'environment'), 0) AS BIGINT) AS environment,
       CAST(coalesce(sum(count) FILTER (category = 'food'), 0) AS BIGINT) AS food,
       CAST(coalesce(sum(count) FILTER (category = 'medication'), 0) AS BIGINT) AS medication
FROM discovery GROUP BY year""", qa.DISCOVERY_SQL))
def r3_discovery_trends_by_category(spark, sf_dir):
    return rs.trends_by_category(al.discovery_trends(proxy.allergies(spark, sf_dir)))


@query("r4_severity_by_nature", with_views(["allergies"], "SELECT allergen_nature, " + ", ".join(
    f"CAST(coalesce(sum(count) FILTER (severity = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in ("MILD", "MODERATE", "SEVERE", "N/A")
) + " FROM matrix GROUP BY allergen_nature", qa.MATRIX_SQL))
def r4_severity_by_nature(spark, sf_dir):
    return rs.severity_by_nature(al.nature_severity_matrix(proxy.allergies(spark, sf_dir)))


ENCOUNTER_KPIS = [
    "total_visit_volume", "total_revenue_generated", "average_encounter_duration_hours",
    "average_patient_out_of_pocket", "average_base_fee", "total_covered_amount",
    "unique_patients_seen", "average_practitioner_load",
]
TIDY_SQL = qe.KPIS_SQL + ", tidy AS (" + " UNION ALL ".join(
    f"SELECT period, '{k}' AS kpi, {k}::DOUBLE AS value FROM encounter_kpis" for k in ENCOUNTER_KPIS
) + ")"


@query("r9_tidy_kpis", with_views(["encounters", "periods"], "SELECT * FROM tidy", TIDY_SQL))
def r9_tidy_kpis(spark, sf_dir):
    return rs.tidy_kpis(en.encounter_kpis(proxy.encounters(spark, sf_dir), AS_OF))


@query("r5_kpi_delta", with_views(["encounters", "periods"], """
SELECT p.kpi, p.period, round(c.value, 2) AS current_value, round(p.value, 2) AS previous_value,
       round(c.value - p.value, 2) AS difference,
       round(coalesce((c.value - p.value) / nullif(p.value, 0), 0) * 100, 2) AS percent_change,
       CASE WHEN c.value = p.value THEN 'unchanged'
            WHEN (c.value > p.value) <> (p.kpi IN ('average_encounter_duration_hours', 'average_patient_out_of_pocket',
                                                   'average_base_fee', 'average_practitioner_load')) THEN 'improved'
            ELSE 'worsened' END AS direction
FROM tidy p JOIN tidy c ON c.kpi = p.kpi AND c.period = 'current' WHERE p.period <> 'current'""", TIDY_SQL))
def r5_kpi_delta(spark, sf_dir):
    return rs.kpi_delta(en.encounter_kpis(proxy.encounters(spark, sf_dir), AS_OF))


RANKED = ["total_visit_volume", "average_base_fee", "encounters_30d"]


@query("r6_state_ranking", with_views(["encounters", "patients", "states"], """
SELECT kpi_id, geolocated_state, value,
       rank() OVER (PARTITION BY kpi_id ORDER BY CASE WHEN kpi_id = 'average_base_fee' THEN value ELSE -value END) AS rank,
       min(value) OVER (PARTITION BY kpi_id) AS min_value, max(value) OVER (PARTITION BY kpi_id) AS max_value
FROM (""" + " UNION ALL ".join(
    f"SELECT geolocated_state, '{k}' AS kpi_id, {k}::DOUBLE AS value FROM by_state" for k in RANKED
) + ")", qg.ENCOUNTERS_SQL))
def r6_state_ranking(spark, sf_dir):
    wide = geo.family_by_state("encounters", proxy.tables(spark, sf_dir, "encounters", "patients"), proxy.states(spark, sf_dir), AS_OF)
    tidy = wide.select(geo.STATE, *[F.col(k).cast("double").alias(k) for k in RANKED]).unpivot(geo.STATE, RANKED, "kpi_id", "value")
    return rs.state_ranking(tidy)


@query("r7_transition_nodes", with_views(["conditions"], """
SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming
FROM (SELECT item_a AS node, transitions AS o, 0 AS i FROM transitions
      UNION ALL SELECT item_b, 0, transitions FROM transitions) GROUP BY node""", qc.ALL_TRANSITIONS_SQL))
def r7_transition_nodes(spark, sf_dir):
    return rs.transition_nodes(co.disease_transitions(proxy.conditions(spark, sf_dir), k=None))


@query("r8_top_anomalies", f"""
SELECT * FROM ({ORACLES["e17_high_cost_anomaly_index"]}) ORDER BY anomaly_count DESC, encounter_reason LIMIT 10""")
def r8_top_anomalies(spark, sf_dir):
    found = en.high_cost_anomalies(proxy.event_fees(spark, sf_dir))
    return rs.top_rows(found, 10, F.desc("anomaly_count"), "encounter_reason")


@query("r8_shortest_recurrence_gaps", qc.gap_sql("avg_gap_days", 5))
def r8_shortest_recurrence_gaps(spark, sf_dir):
    return rs.top_rows(co.recurrence_gap(proxy.conditions(spark, sf_dir), k=None), 5, "avg_gap_days", "medical_concepts")


@query("r8_top_pairs", with_views(["conditions"], """
SELECT * FROM pairs ORDER BY patients DESC, item_a, item_b LIMIT 15""", qc.PAIRS_SQL))
def r8_top_pairs(spark, sf_dir):
    return rs.top_rows(co.concept_cooccurrence(proxy.conditions(spark, sf_dir)), 15, F.desc("patients"), "item_a", "item_b")


@query("r10_concept_search", with_views(["conditions"], """
SELECT * FROM incidence WHERE contains(lower(medical_concepts), 'ring')""", qc.ALL_INCIDENCE_SQL))
def r10_concept_search(spark, sf_dir):
    return rs.search_concepts(co.incidence_velocity(proxy.conditions(spark, sf_dir), k=None), "RING")


@query("r11_executive_summary", f"""
SELECT p.period, total_patients, current_active_burden, average_time_to_cure, global_recovery_rate,
       total_revenue_generated, unique_patients_seen, total_covered_amount, average_patient_out_of_pocket
FROM ({ORACLES["p_kpis_by_period"]}) p
LEFT JOIN ({ORACLES["c_kpis_by_period"]}) c ON c.period = p.period
LEFT JOIN ({ORACLES["e_kpis_by_period"]}) e ON e.period = p.period""")
def r11_executive_summary(spark, sf_dir):
    t = proxy.tables(spark, sf_dir, "patients", "conditions", "encounters")
    return rs.executive_summary(
        pa.patient_kpis(t.patients, AS_OF), co.condition_kpis(t.conditions, AS_OF), en.encounter_kpis(t.encounters, AS_OF)
    )
