"""Reshapes that reports need: pivots, period comparison, rankings, networks, unpivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions.columns import pct
from careflow.schemas import ALLERGY_CATEGORIES, LOWER_IS_BETTER, SEVERITIES


def survival_curves(life_table: DataFrame) -> DataFrame:
    """Age -> male and female survival in percent."""
    return (
        life_table.groupBy("age").pivot("gender", ["M", "F"]).agg(F.first("survival"))
        .select("age", *[F.round(F.coalesce(F.col(g), F.lit(0.0)) * 100, 1).alias(n) for g, n in (("M", "male"), ("F", "female"))])
    )


def _names(df: DataFrame, column: str, names: Sequence[str] | None) -> list[str]:
    """The pivot's columns: those given, then all others in the data, in order. Their number is that of the columns made."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]
    return [*(names or ()), *(n for n in found if n not in (names or ()))]


def hazard_by_race(hazard: DataFrame, races: Sequence[str] | None = None) -> DataFrame:
    """R2: income bin -> hazard in percent per race, 0 where a race has no such bin.

    Every race of ``hazard`` has a column; ``races`` come first, whether they occur or not.
    """
    races = _names(hazard, "race", races)
    wide = hazard.groupBy("bin", "label").pivot("race", list(races)).agg(F.first("hazard"))
    return wide.select("bin", "label", *[F.round(F.coalesce(F.col(f"`{r}`"), F.lit(0.0)) * 100, 1).alias(r) for r in races])


def trends_by_category(trends: DataFrame, categories: Sequence[str] = ALLERGY_CATEGORIES) -> DataFrame:
    """Year -> detections per category, 0 filled; undated records are left out.

    Every category in the data has a column, those without one are ``unknown``; ``categories`` come first, whether they occur or not.
    """
    dated = trends.where(F.col("year") > 0).withColumn("category", F.coalesce("category", F.lit("unknown")))
    names = _names(dated, "category", categories)
    return dated.groupBy("year").pivot("category", names).agg(F.sum("count")).fillna(0, names)


def severity_by_nature(matrix: DataFrame, severities: Sequence[str] = SEVERITIES) -> DataFrame:
    """Allergen nature -> counts per severity, 0 filled.

    Every severity in the data has a column, rows without one are ``unknown``, as are those without a nature; ``severities`` come first, whether they
    occur or not.
    """
    named = matrix.select(F.coalesce("allergen_nature", F.lit("unknown")).alias("allergen_nature"), F.coalesce("severity", F.lit("unknown")).alias("severity"), "count")
    names = _names(named, "severity", severities)
    return named.groupBy("allergen_nature").pivot("severity", names).agg(F.sum("count")).fillna(0, names)


def tidy_kpis(kpis: DataFrame) -> DataFrame:
    """Wide KPI rows per period -> (period, kpi, value)."""
    names = [c for c in kpis.columns if c != "period"]
    return kpis.select("period", *[F.col(n).cast("double").alias(n) for n in names]).unpivot("period", names, "kpi", "value")


def kpi_delta(kpis: DataFrame) -> DataFrame:
    """Current value against each past period: difference, percentage, improved or worsened.

    A period without a snapshot gives no row; nothing is invented for it.
    """
    past = ["last_week", "last_month", "last_year"]
    value_at = lambda p: F.max(F.when(F.col("period") == p, F.col("value"))).alias(p)
    per_kpi = tidy_kpis(kpis).groupBy("kpi").agg(value_at("current"), *[value_at(p) for p in past])
    rows = per_kpi.unpivot(["kpi", "current"], past, "period", "previous").where(F.col("previous").isNotNull())
    diff = F.col("current") - F.col("previous")
    better = (diff > 0) != F.col("kpi").isin(LOWER_IS_BETTER)
    return rows.select(
        "kpi", "period",
        F.round("current", 2).alias("current_value"),
        F.round("previous", 2).alias("previous_value"),
        F.round(diff, 2).alias("difference"),
        pct(diff, F.col("previous"), 2).alias("percent_change"),
        F.when(diff == 0, "unchanged").when(better, "improved").otherwise("worsened").alias("direction"),
    )


def state_ranking(state_values: DataFrame, state: str = "geolocated_state") -> DataFrame:
    """Rank of each state within its KPI (best first by sentiment) and the KPI's range."""
    own = Window.partitionBy("kpi_id")
    signed = F.when(F.col("kpi_id").isin(LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    return state_values.select(
        "kpi_id", state, "value",
        F.rank().over(own.orderBy(signed)).cast("bigint").alias("rank"),
        F.min("value").over(own).alias("min_value"),
        F.max("value").over(own).alias("max_value"),
    )


def transition_nodes(edges: DataFrame) -> DataFrame:
    """Distinct endpoints of the transition edges with their weighted degrees."""
    ends = F.inline(F.array(
        F.struct(F.col("item_a").alias("node"), F.col("transitions").alias("out"), F.lit(0).cast("bigint").alias("in")),
        F.struct(F.col("item_b").alias("node"), F.lit(0).cast("bigint").alias("out"), F.col("transitions").alias("in")),
    ))
    return edges.select(ends).groupBy("node").agg(
        F.sum("out").alias("outgoing"), F.sum("in").alias("incoming")
    )


def top_rows(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows in the given order."""
    return df.orderBy(*order).limit(k)


def search_concepts(monthly: DataFrame, text: str, column: str = "medical_concepts") -> DataFrame:
    """Rows whose concept contains ``text``, ignoring case; order by ``month_number`` to show."""
    return monthly.where(F.contains(F.lower(column), F.lit(text.lower())))


# The KPIs of the executive summary.
SUMMARY_KPIS = {
    "patients": ["total_patients"],
    "conditions": ["current_active_burden", "average_time_to_cure", "global_recovery_rate"],
    "encounters": [
        "total_revenue_generated", "unique_patients_seen", "total_covered_amount",
        "average_patient_out_of_pocket",
    ],
}


def executive_summary(patients: DataFrame, conditions: DataFrame, encounters: DataFrame) -> DataFrame:
    """Selected KPIs of three entities side by side, one row per period of the patients."""
    keep = lambda df, e: df.select("period", *SUMMARY_KPIS[e])
    return (
        keep(patients, "patients")
        .join(keep(conditions, "conditions"), "period", "left")
        .join(keep(encounters, "encounters"), "period", "left")
    )
