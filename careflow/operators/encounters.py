"""Encounter analytics: volume, fees, coverage, practitioners, readmission and cost anomalies."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.functions.columns import hours_between, known_on, money, ratio, rounded, text_month
from careflow.functions.periods import Period, by_period
from careflow.operators import statistics as st

BASE, TOTAL, COVERAGE = "visiting_base_fees", "visting_total_fees", "coverage"
OUT_OF_POCKET = f"({TOTAL} - coalesce({COVERAGE}, 0.0D))"


def duration_hours() -> Column:
    return hours_between(F.col("visit_start"), F.col("visit_end"))


def exact_parts(amount: str) -> dict[str, str]:
    """An amount as whole units and millionths, so that its total is exact in 64-bit sums."""
    millionths = f"floor({amount} * 1000000D + 0.5D)"
    return {"units": f"{millionths} div 1000000", "rest": f"{millionths} % 1000000"}


def exact_total(name: str) -> Column:
    return F.expr(f"CAST({name}_units AS DECIMAL(20,0)) + CAST({name}_rest AS DECIMAL(20,0)) * 0.000001BD")


def exact_sums(**amounts: str) -> list[Column]:
    """Aggregates from which ``exact_mean`` and ``exact_total`` of named amounts follow: whatever the order of addition, they are the same."""
    return [F.expr(f"sum({part})").alias(f"{name}_{n}") for name, amount in amounts.items() for n, part in exact_parts(amount).items()]


def exact_mean(name: str, count: str = "n") -> Column:
    """The exact total of an amount over a count of rows, divided once; as double, NULL without rows."""
    return F.try_divide(exact_total(name).cast("double"), F.col(count).cast("double"))


def fill_missing_fees(encounters: DataFrame) -> DataFrame:
    """NULL fees become 0.0. Every metric of fees does this first, so callers need not."""
    return encounters.fillna(0.0, [c for c in (BASE, TOTAL, COVERAGE) if c in encounters.columns])


# What each encounter adds to the sums of the KPIs, on rows with filled fees.
AMOUNTS = {"revenue": TOTAL, "oop": OUT_OF_POCKET, "base": BASE, "covered": COVERAGE}
ADDENDS: dict[str, str] = {
    "visits": "1L",
    "seconds": "coalesce(unix_timestamp(visit_end) - unix_timestamp(visit_start), 0L)",
    "timed": "CAST(visit_end IS NOT NULL AND visit_start IS NOT NULL AS BIGINT)",
    **{f"{name}_{n}": part for name, amount in AMOUNTS.items() for n, part in exact_parts(amount).items()},
}


def started(encounters: DataFrame) -> DataFrame:
    """Encounters with filled fees and ``_started``, the first date as of which each is known."""
    return fill_missing_fees(encounters).withColumn("_started", known_on(F.col("visit_start")))


def facts_by_key(encounters: DataFrame, key: Callable[[str], str], by: Sequence[str] = (), counted: Sequence[str] = ()) -> DataFrame:
    """(kind, key, first_on, sums): a row for each day, patient and practitioner of some encounters, and each value of ``by``.

    ``kind`` is ``day``, ``patient`` or ``practitioner``, ``key`` its value as text made by ``key``; only days have sums. Of columns in ``counted`` there is a
    row for each value too, with its number of ``visits``, the column's name being the ``kind``. Partial sums are combined before the
    shuffle, so a patient or day with a third of all rows sends one row from each task.
    """
    facts = ", ".join(f"'{n}', {{{n}}}" for n in ADDENDS)
    day = facts.format(**ADDENDS)
    nothing = dict.fromkeys(ADDENDS, "CAST(NULL AS BIGINT)")
    none, once = facts.format(**nothing), facts.format(**(nothing | {"visits": "1L"}))
    kinds = [("day", "_started", day), ("patient", "uuid", none), ("practitioner", "practioner_id", none), *[(c, c, once) for c in counted]]
    rows = started(encounters).selectExpr(
        *by, "_started",
        "inline(array(" + ", ".join(f"named_struct('kind', '{kind}', 'key', {key(c)}, {sums})" for kind, c, sums in kinds) + "))",
    )
    return rows.groupBy(*by, "kind", "key").agg(F.min("_started").alias("first_on"), *[F.sum(n).alias(n) for n in ADDENDS])


def seen_by_period(kind: str = "kind", key: str = "key IS NOT NULL", first_on: str = "first_on"):
    """Measures of distinct patients and practitioners from the first date each was seen."""

    def measures(p: Period) -> dict[str, str]:
        seen = p.happened(first_on)
        return {
            "patients": f"count_if({seen} AND {kind} = 'patient' AND {key})",
            "practitioners": f"count_if({seen} AND {kind} = 'practitioner')",
        }

    return measures


def sums_by_period(date: str, addends: dict[str, str]):
    """Measures of the sums of the KPIs over rows dated ``date``."""
    return lambda p: {n: f"sum(IF({p.happened(date)}, {e}, NULL))" for n, e in addends.items()}


def kpi_columns() -> list[Column]:
    """E1-E8 from the sums and distinct counts of a period."""
    return [
        F.col("visits").alias("total_visit_volume"),
        money(exact_total("revenue")).alias("total_revenue_generated"),
        rounded(F.try_divide(F.col("seconds") / F.lit(3600.0), F.col("timed"))).alias("average_encounter_duration_hours"),
        rounded(exact_mean("oop", "visits")).alias("average_patient_out_of_pocket"),
        rounded(exact_mean("base", "visits")).alias("average_base_fee"),
        money(exact_total("covered")).alias("total_covered_amount"),
        F.col("patients").alias("unique_patients_seen"),
        rounded(ratio(F.col("visits"), F.col("practitioners"))).alias("average_practitioner_load"),
    ]


def encounter_kpis(encounters: DataFrame, as_of: dt.date) -> DataFrame:
    """The eight encounter KPIs per period.

    The encounters are read once: sums are reduced to days, distinct patients and practitioners to the first date each
    was seen, in one shuffle, and every period follows from these. A NULL practitioner is one group in the load, as recorded.
    """
    return kpis_of_facts(facts_by_key(encounters, "CAST({} AS STRING)".format), as_of)


def kpis_of_facts(facts: DataFrame, as_of: dt.date, key: str = "key IS NOT NULL") -> DataFrame:
    """E1-E8, E10 from the rows of ``facts_by_key``, by one aggregate; ``key`` tells whether a patient has one."""
    seen = seen_by_period(key=key)
    sums = sums_by_period("first_on", {n: f"IF(kind = 'day', {n}, NULL)" for n in ADDENDS})
    rows = by_period(facts, as_of, lambda p: sums(p) | seen(p))
    return rows.where(F.col("visits") > 0).select("period", *kpi_columns())


def counts_of_facts(facts: DataFrame, column: str) -> DataFrame:
    """The number of encounters of each value of a column that ``facts_by_key`` counted."""
    return facts.where((F.col("kind") == column) & F.col("key").isNotNull()).select(F.col("key").alias(column), F.col("visits").alias("count"))


def _typed(encounters: DataFrame) -> DataFrame:
    return encounters.where(F.col("encounter_type").isNotNull())


def encounters_by_type(encounters: DataFrame) -> DataFrame:
    """E11."""
    return _typed(encounters).groupBy("encounter_type").agg(F.count(F.lit(1)).alias("count"))


def top_causes(encounters: DataFrame, k: int = 10) -> DataFrame:
    """E12."""
    return st.top_k(encounters, "encounter_reason", k)


def coverage_vs_oop_by_type(encounters: DataFrame) -> DataFrame:
    """E13."""
    sums = _typed(fill_missing_fees(encounters)).groupBy("encounter_type").agg(F.count(F.lit(1)).alias("n"), *exact_sums(covered=COVERAGE, oop=OUT_OF_POCKET))
    return sums.select(
        "encounter_type", rounded(exact_mean("covered")).alias("avg_covered"), rounded(exact_mean("oop")).alias("avg_out_of_pocket")
    )


def top_practitioners(encounters: DataFrame, k: int = 10) -> DataFrame:
    """NULL practitioners are removed before the cut, so k names are returned."""
    return st.top_k(encounters, "practioner_id", k)


def fee_divergence_by_type(encounters: DataFrame) -> DataFrame:
    """E15."""
    sums = _typed(fill_missing_fees(encounters)).groupBy("encounter_type").agg(F.count(F.lit(1)).alias("n"), *exact_sums(base=BASE, total=TOTAL))
    return sums.select("encounter_type", rounded(exact_mean("base")).alias("avg_base"), rounded(exact_mean("total")).alias("avg_total"))


def most_expensive_causes(encounters: DataFrame, k: int = 10) -> DataFrame:
    """The cut is by exact means, so that no order of rows decides who is in."""
    return (
        fill_missing_fees(encounters).where(F.col("encounter_reason").isNotNull())
        .groupBy("encounter_reason")
        .agg(F.count(F.lit(1)).alias("n"), *exact_sums(total=TOTAL))
        .select("encounter_reason", rounded(exact_mean("total")).alias("avg_total"))
        .orderBy(F.desc("avg_total"), "encounter_reason")
        .limit(k)
    )


def high_cost_anomalies(encounters: DataFrame, k: float = 2.0) -> DataFrame:
    """Encounters per reason whose fee exceeds mean + k standard deviations of the reason."""
    named = fill_missing_fees(encounters).where(F.col("encounter_reason").isNotNull())
    return st.zscore_outliers(named, "encounter_reason", TOTAL, k)


def duration_by_type(encounters: DataFrame) -> DataFrame:
    """E18."""
    return _typed(encounters).groupBy("encounter_type").agg(rounded(F.avg(duration_hours())).alias("avg_hours"))


def _last_months(monthly: DataFrame, months: int) -> DataFrame:
    return monthly.orderBy(F.desc("month_start")).limit(months).withColumn("label", text_month(F.col("month_start")))


def _by_month(encounters: DataFrame) -> DataFrame:
    month = F.trunc(F.to_date("visit_start"), "month")
    return encounters.where(F.col("visit_start").isNotNull()).withColumn("month_start", month)


def readmission_timeline(encounters: DataFrame, months: int = 12) -> DataFrame:
    """Patients, and patients with more than one visit, in each of the last months.

    Visits are counted per (month, patient) and those counts per month: one two-level aggregate
    instead of a join of two. A month without repeats shows 0.
    """
    monthly = (
        _by_month(encounters)
        .groupBy("month_start", "uuid").agg(F.count(F.lit(1)).alias("visits"))
        .groupBy("month_start")
        .agg(
            F.count("uuid").alias("unique_patients"),
            F.count_if((F.col("visits") > 1) & F.col("uuid").isNotNull()).alias("repeat_patients"),
        )
    )
    return _last_months(monthly, months)


def uncovered_cost_trajectory(encounters: DataFrame, months: int = 12) -> DataFrame:
    """Average out-of-pocket cost in each of the last months."""
    sums = _by_month(fill_missing_fees(encounters)).groupBy("month_start").agg(F.count(F.lit(1)).alias("n"), *exact_sums(oop=OUT_OF_POCKET))
    return _last_months(sums.select("month_start", rounded(exact_mean("oop")).alias("avg_out_of_pocket")), months)
