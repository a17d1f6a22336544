"""Physical plans as they would be on large tables: broadcasting by size is switched off."""

from __future__ import annotations

import re

import pytest

from careflow.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def plan_of(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scan_reads_only_used_columns(plan_of):
    plan = plan_of("t15_known_parents")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    # the key list is not repeated, and the join's partitioning binds nothing after it, so a hot key may be split
    assert re.search(r"SortMergeJoin \[o_custkey#\d+L\]", plan) and "Generate" not in plan
    assert re.search(r"Exchange [^\n]*REBALANCE[\s\S]*SortMergeJoin", plan)
    assert re.search(r"PushedFilters: \[.*GreaterThan\(c_acctbal,0\.0\)", plan)
    plan = plan_of("e12_top_causes")
    assert "l_extendedprice" not in plan and "TakeOrderedAndProject" in plan


def test_kpi_snapshots_group_without_shuffling_rows(plan_of):
    """The eight patient KPIs of four periods leave each task as one row."""
    plan = plan_of("p_kpis_by_period")
    assert plan.count("Exchange SinglePartition") == 1
    assert "Expand" not in plan


def line_scans(plan: str) -> int:
    return len(re.findall(r"FileScan parquet \[l_", plan))


def test_state_kpis_shuffle_no_sums_by_practitioner(plan_of):
    """One row a patient travels to the states; of practitioners only the names do, and not even these where no KPI needs them."""
    plan = plan_of("g7_encounter_kpis_by_state")
    assert line_scans(plan) == 2 and re.search(r"HashAggregate\(keys=\[geolocated_state#\d+, practioner_id#\d+\], functions=\[\]", plan)
    assert not re.search(r"HashAggregate\(keys=\[geolocated_state#\d+, practioner_id#\d+\], functions=\[\w", plan)
    plan = plan_of("g1_state_kpi_by_id")
    assert line_scans(plan) == 1 and "practioner_id" not in plan


def test_encounter_kpis_read_encounters_once(plan_of):
    assert line_scans(plan_of("e_kpis_by_period")) == 1
    assert line_scans(plan_of("r9_tidy_kpis")) == 1


def test_condition_kpis_read_conditions_once_for_all_distinct_measures(plan_of):
    assert line_scans(plan_of("c_kpis_by_period")) == 2
    assert line_scans(plan_of("r11_executive_summary")) == 3


def test_parts_cut_lines_before_they_travel_to_the_orders(plan_of):
    plan = plan_of("a12_severity_distribution")
    assert plan.index("SortMergeJoin [l_orderkey") < plan.index("SortMergeJoin [l_partkey")


def test_latest_row_is_cut_before_the_shuffle(spark):
    from careflow.sources.store import latest_by_key

    df = latest_by_key(spark.range(10).selectExpr("id % 3 AS k", "id AS at"), ["k"], "at")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", plan)
