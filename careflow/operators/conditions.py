"""Condition analytics: burden, recovery, comorbidity, transitions and recurrence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions.columns import (
    ceiled, day, decade, decade_label, month_label, pct, years_between,
)
from careflow.functions.periods import Period, by_period, periods
from careflow.operators import pairs, statistics as st

CHRONIC_DAYS = 90


def is_open() -> Column:
    return F.col("date_of_abetment").isNull()


def is_resolved() -> Column:
    return F.col("date_of_abetment").isNotNull()


def _disorders(conditions: DataFrame) -> DataFrame:
    return conditions.where(F.col("associated_semantics") == "disorder")


def concept_dates(conditions: DataFrame) -> DataFrame:
    """(uuid, medical_concepts, first_on, cured_on, resolved): the first dates on which a patient has and has got over a concept."""
    record, end = "condition_record_date", "date_of_abetment"
    return conditions.groupBy("uuid", "medical_concepts").agg(
        F.min(record).alias("first_on"),
        F.expr(f"min(IF({record} IS NOT NULL AND {end} IS NOT NULL, greatest({record}, {end}), NULL)) AS cured_on"),
        F.bool_or(is_resolved()).alias("resolved"),
    )


def condition_kpis(conditions: DataFrame, as_of: dt.date) -> DataFrame:
    """The eight condition KPIs per period (row counts, distinct concepts, complexity).

    Row measures take one scan and one shuffle-free aggregate. Distinct measures reduce to the
    first date a (patient, concept) counts, from which every period follows.
    """
    return kpis_of_spans(conditions.withColumn("n", F.lit(1).cast("bigint")), concept_dates(conditions), as_of)


def kpis_of_spans(spans: DataFrame, per_concept: DataFrame, as_of: dt.date) -> DataFrame:
    """C1-C9 from ``n`` conditions for each record date and date of abetment, and the rows of ``concept_dates``."""
    record, end = "condition_record_date", "date_of_abetment"

    def row_measures(p: Period) -> dict[str, str]:
        inside = p.happened(record)
        cured = f"({inside} AND {p.ended(end)})"
        number = lambda which: f"coalesce(sum(IF({which}, n, 0L)), 0L)"
        days = f"datediff({end}, {record})"
        return {
            "total": number(inside),
            "cured": number(cured),
            "cure_days": f"sum(IF({cured}, n * {days}, NULL)) / sum(IF({cured} AND {days} IS NOT NULL, n, NULL))",
            "recent": number(f"{inside} AND {record} >= date_sub({p.date}, 30)"),
            "chronic": number(f"{inside} AND NOT {p.ended(end)} AND datediff({p.date}, {record}) >= {CHRONIC_DAYS}"),
        }

    rows = by_period(spans, as_of, row_measures)
    # one pass and one shuffle serve the distinct concepts and the complexity: (kind, key) -> what each period needs
    keys = (
        "inline(array(named_struct('kind', 'concept', 'key', CAST(medical_concepts AS STRING), 'first_on', first_on), "
        "named_struct('kind', 'patient', 'key', CAST(uuid AS STRING), 'first_on', CAST(NULL AS DATE))))"
    )
    ends = per_concept.selectExpr("resolved", "cured_on", "medical_concepts IS NOT NULL AS named", keys).where("kind = 'concept' OR resolved")
    # a NULL concept makes a patient count without adding a concept
    cured_by = [
        F.expr(f"count_if(kind = 'patient' AND {p.happened('cured_on')}{named}) AS `{n}_{p.name}`")
        for p in periods(as_of) for n, named in (("patient", ""), ("k", " AND named"))
    ]
    distinct = ends.groupBy("kind", "key").agg(F.min("first_on").alias("first_on"), *cured_by).transform(lambda d: by_period(
        d, as_of,
        lambda p: {
            "concepts": f"count_if(kind = 'concept' AND {p.happened('first_on')})",
            "complexity": f"avg(IF(`patient_{p.name}` > 0, `k_{p.name}`, NULL))",
        },
    ))
    total, cured = F.col("total"), F.col("cured")
    return (
        rows.where(total > 0).join(distinct, "period")
        .select(
            "period",
            (total - cured).alias("current_active_burden"),
            pct(cured, total, 2).alias("global_recovery_rate"),
            ceiled(F.col("complexity")).alias("patient_complexity_score"),
            ceiled(F.col("cure_days")).alias("average_time_to_cure"),
            F.col("recent").alias("admission_rate_last_30_days"),
            total.alias("total_diagnoses"),
            F.col("concepts").alias("unique_conditions"),
            F.col("chronic").alias("chronic_condition_burden"),
        )
    )


def top_disorder_conditions(conditions: DataFrame, k: int = 10) -> DataFrame:
    """C10."""
    return st.top_k(_disorders(conditions).where(is_open()), "medical_concepts", k, "open_count")


def chronic_vs_acute(conditions: DataFrame, as_of: dt.date) -> DataFrame:
    """C11: disorders lasting at least 90 days (open ones until ``as_of``) against the rest."""
    length = F.datediff(F.coalesce("date_of_abetment", day(as_of)), F.col("condition_record_date"))
    course = F.when(length >= CHRONIC_DAYS, "chronic").otherwise("acute")
    return _disorders(conditions).groupBy(course.alias("clinical_course")).agg(F.count("uuid").alias("count"))


def disease_resolution_efficiency(conditions: DataFrame, k: int = 20) -> DataFrame:
    """The k disorders cured fastest on average."""
    length = F.datediff("date_of_abetment", "condition_record_date")
    return (
        _disorders(conditions).where(is_resolved())
        .groupBy("medical_concepts")
        .agg(
            F.count("uuid").alias("frequency"),
            F.floor(F.coalesce(F.avg(length), F.lit(1.0))).cast("bigint").alias("avg_time_to_cure"),
        )
        .orderBy("avg_time_to_cure", F.desc("frequency"), "medical_concepts")
        .limit(k)
    )


def recurring_disorders(conditions: DataFrame, k: int = 10) -> DataFrame:
    """Disorders by the number of patients who had them more than once."""
    return (
        _disorders(conditions)
        .groupBy("uuid", "medical_concepts").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy("medical_concepts").agg(F.count("uuid").alias("recurring_patients"))
        .orderBy(F.desc("recurring_patients"), "medical_concepts")
        .limit(k)
    )


def comorbidity_pattern(conditions: DataFrame) -> DataFrame:
    """C14: number of patients per number of open disorders."""
    return (
        _disorders(conditions).where(is_open())
        .groupBy("uuid").agg(F.count("medical_concepts").alias("open_disorders"))
        .groupBy("open_disorders").agg(F.count("uuid").alias("patients"))
    )


def clinical_gravity(conditions: DataFrame, k: int = 15) -> DataFrame:
    """Average number of other open concepts carried by the open rows of a concept.

    The load of a patient comes from a window over its distinct concepts, so no row is joined
    back; row multiplicities enter as weights.
    """
    own = Window.partitionBy("uuid")
    n = F.col("n").cast("double")
    return (
        conditions.where(is_open())
        .groupBy("uuid", "medical_concepts").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("load", F.count("medical_concepts").over(own))
        .where(F.col("uuid").isNotNull())
        .groupBy("medical_concepts")
        .agg(
            F.count("uuid").alias("patients"),
            F.round(F.sum(n * (F.col("load") - 1)) / F.sum(n), 0).alias("score"),
        )
        .orderBy(F.desc("score"), "medical_concepts")
        .limit(k)
    )


def incidence_velocity(conditions: DataFrame, k: int | None = 15) -> DataFrame:
    """Records per calendar month for the k most frequent concepts (None: for all)."""
    monthly = (
        conditions.where(F.col("medical_concepts").isNotNull() & F.col("condition_record_date").isNotNull())
        .groupBy("medical_concepts", F.month("condition_record_date").alias("month_number"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if k is not None:
        top = (
            monthly.groupBy("medical_concepts").agg(F.sum("count").alias("total"))
            .orderBy(F.desc("total"), "medical_concepts")
            .limit(k)
            .select("medical_concepts")
        )
        monthly = monthly.join(top, "medical_concepts", "left_semi")
    return monthly.select(
        "medical_concepts", "month_number", month_label(F.col("month_number")).alias("month"), "count"
    )


def concept_cooccurrence(conditions: DataFrame, k: int = 50) -> DataFrame:
    """C17."""
    return pairs.cooccurrence(conditions, "uuid", "medical_concepts", k, distinct=True, name="patients")


def disease_transitions(conditions: DataFrame, k: int | None = 50, horizon: int = 365) -> DataFrame:
    """C18."""
    return pairs.transitions(conditions, "uuid", "medical_concepts", "condition_record_date", k, horizon)


def recurrence_gap(conditions: DataFrame, k: int | None = 10) -> DataFrame:
    """The k concepts with the longest average gap between end and recurrence (None: all)."""
    gaps = pairs.recurrence_gaps(conditions, "uuid", "medical_concepts", "condition_record_date", "date_of_abetment")
    if k is not None:
        gaps = gaps.orderBy(F.desc("avg_gap"), "medical_concepts").limit(k)
    return gaps.select("medical_concepts", F.col("avg_gap").cast("bigint").alias("avg_gap_days"))


def age_based_burden(conditions: DataFrame, patients: DataFrame) -> DataFrame:
    """C20: condition records per decade of onset age, 0 <= age < 120.

    Records are counted per (patient, day) before the join, so no patient is hot in it.
    """
    age = F.floor(years_between(F.col("birth_date"), F.col("condition_record_date")))
    return (
        conditions.groupBy("uuid", "condition_record_date").agg(F.count(F.lit(1)).alias("n"))
        .join(patients.select("uuid", "birth_date"), "uuid")
        .select(age.alias("age"), "n")
        .where((F.col("age") >= 0) & (F.col("age") < 120))
        .groupBy(decade(F.col("age")).alias("age_from"), decade_label(F.col("age")).alias("age_group"))
        .agg(F.sum("n").alias("count"))
    )


def average_open_conditions(conditions: DataFrame) -> DataFrame:
    """Open conditions per patient who has any, rounded up."""
    return (
        conditions.where(is_open() & F.col("uuid").isNotNull())
        .groupBy("uuid").agg(F.count("condition_record_date").alias("n"))
        .agg(ceiled(F.avg("n")).alias("avg_open_conditions"))
    )
