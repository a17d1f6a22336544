"""Allergy analytics: incidence, severity, de-labelling, readmission, cross-reactivity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions.columns import decade, decade_label, month_label, pct, ratio, years_between
from careflow.functions.periods import Period, by_period
from careflow.operators import pairs, statistics as st
from careflow.operators.patients import population

# The penicillin allergen and the reaction that rules de-labelling out.
PENICILLIN_PATTERN = "^[pP]enicillin$"
ANAPHYLAXIS = "Anaphylaxis"
READMISSION_DAYS = 30

IS_PENICILLIN = f"coalesce(allergy_description RLIKE '{PENICILLIN_PATTERN}', false)"
# penicillin allergy without a severe symptom and without anaphylaxis
IS_ELIGIBLE = (
    f"({IS_PENICILLIN} AND primary_symptom_severity <> 'SEVERE' AND secondary_symptom_severity <> 'SEVERE' "
    f"AND primary_symptom_description <> '{ANAPHYLAXIS}')"
)
IS_DRUG = "(coalesce(category = 'medication', false) OR coalesce(allergen_nature = 'drug', false))"
IS_ENVIRONMENTAL = "(category = 'environment' OR allergen_nature = 'environment')"


def code_dates(allergies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(uuid, allergy_code, on, drug_on, drug): the first days on which a patient has a code, and has it as a drug allergy; for each value of ``by``."""
    detected = F.col("allergy_detection_date")
    return (
        allergies.where(F.col("uuid").isNotNull())
        .groupBy(*by, "uuid", "allergy_code")
        .agg(
            F.min(detected).alias("on"),
            F.min(F.when(F.expr(IS_DRUG), detected)).alias("drug_on"),
            F.bool_or(F.expr(IS_DRUG)).alias("drug"),
        )
    )


def visit_days(encounters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(uuid, day) of each visit."""
    return encounters.select(*by, "uuid", F.to_date("visit_start").alias("day")).where("uuid IS NOT NULL AND day IS NOT NULL")


def allergic_patients(allergies: DataFrame, encounters: DataFrame) -> DataFrame:
    """One row per allergic patient with the first day each patient-level fact holds.

    ``allergic_on``, ``drug_on``, ``poly_on`` (second distinct code detected), ``readmitted_on``.
    Every period and every state report of the distinct-patient KPIs follows from these dates.
    """
    return patients_of_codes(code_dates(allergies), visit_days(encounters))


def patients_of_codes(per_code: DataFrame, visits: DataFrame) -> DataFrame:
    """The rows of ``allergic_patients`` from those of ``code_dates`` and ``visit_days``."""
    # a patient's codes and visit days meet in one aggregate: some codes and at most a calendar of days each
    code = F.struct(F.col("on").isNull().alias("undated"), "on", F.col("allergy_code").alias("code"))
    entries = per_code.select("uuid", code.alias("entry"), "drug_on", "drug")
    per_patient = entries.unionByName(visits, allowMissingColumns=True).groupBy("uuid").agg(
        F.min("entry.on").alias("allergic_on"),
        F.min("drug_on").alias("drug_on"),
        F.bool_or("drug").alias("drug"),
        F.count("entry").alias("_entries"),
        F.count("entry.code").alias("codes"),
        F.collect_list(F.when(F.col("entry.code").isNotNull(), F.col("entry"))).alias("_coded"),
        F.collect_set("day").alias("_days"),
    ).where("_entries > 0")
    second = F.try_element_at(F.array_sort("_coded"), F.lit(2))["on"]
    return per_patient.select(
        "uuid", "allergic_on", "drug_on", "drug", "codes", second.alias("poly_on"), pairs.first_return(F.col("_days"), READMISSION_DAYS).alias("readmitted_on")
    )


def marked_allergies(allergies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(detection date, cure date, severe, penicillin, eligible) of each allergy: what the row KPIs depend on."""
    flags = {"severe": "coalesce(primary_symptom_severity = 'SEVERE', false)", "penicillin": IS_PENICILLIN, "eligible": f"coalesce({IS_ELIGIBLE}, false)"}
    return allergies.select(*by, "allergy_detection_date", "allergy_cure_date", *[F.expr(e).alias(n) for n, e in flags.items()])


def counted_allergies(allergies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct rows of ``marked_allergies`` and their number ``n``."""
    rows = marked_allergies(allergies, by)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def counted_lives(patients: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(birth_date, death_date, n)."""
    return patients.groupBy(*by, "birth_date", "death_date").agg(F.count(F.lit(1)).alias("n"))


def allergy_kpis(allergies: DataFrame, patients: DataFrame, encounters: DataFrame, as_of: dt.date) -> DataFrame:
    """The eight allergy KPIs per period, with patients and visits as of the period."""
    once = F.lit(1).cast("bigint")
    return kpis_of_counts(marked_allergies(allergies).withColumn("n", once), allergic_patients(allergies, encounters), patients.withColumn("n", once), as_of)


def kpis_of_counts(counted: DataFrame, allergic_people: DataFrame, lives: DataFrame, as_of: dt.date) -> DataFrame:
    """A1-A8, A10 from the rows of ``counted_allergies``, ``allergic_patients`` and ``counted_lives``; rows may come uncounted, each with an ``n`` of 1."""

    def number(which: str) -> str:
        return f"coalesce(sum(IF({which}, n, 0L)), 0L)"

    def row_measures(p: Period) -> dict[str, str]:
        inside = p.happened("allergy_detection_date")
        return {
            "total": number(inside),
            "cured": number(f"{inside} AND {p.ended('allergy_cure_date')}"),
            **{n: number(f"{inside} AND {n}") for n in ("severe", "penicillin", "eligible")},
        }

    def patient_measures(p: Period) -> dict[str, str]:
        allergic = p.happened("allergic_on")
        return {
            "allergic": f"count_if({allergic})",
            "poly": "count_if(codes >= 2)" if p.current else f"count_if({p.happened('poly_on')})",
            "drug": "count_if(drug)" if p.current else f"count_if({p.happened('drug_on')})",
            "readmitted": f"count_if({allergic} AND {p.ended('readmitted_on')})",
        }

    rows = by_period(counted, as_of, row_measures)
    people = by_period(allergic_people, as_of, patient_measures)
    everyone = by_period(lives, as_of, lambda p: {"everyone": number(population(p))})
    total, allergic = F.col("total"), F.col("allergic")
    return (
        rows.where(total > 0).join(people, "period").join(everyone.where("everyone > 0"), "period")
        .select(
            "period",
            allergic.alias("total_allergic_population"),
            pct(total - F.col("cured"), total, 2).alias("active_allergy_percentage"),
            pct(F.col("severe"), total, 2).alias("severe_allergy_incidence_rate"),
            pct(allergic, F.col("everyone"), 2).alias("allergic_patient_rate"),
            pct(F.col("eligible"), F.col("penicillin"), 2).alias("penicillin_allergy_delabeling_eligibility_rate"),
            pct(F.col("readmitted"), allergic, 2).alias("allergy_related_readmission_rate"),
            pct(F.col("poly"), allergic, 2).alias("poly_allergen_patient_rate"),
            pct(F.col("drug"), allergic, 2).alias("drug_hypersensitivity_rate"),
        )
    )


def allergy_risk_stratification(allergies: DataFrame) -> DataFrame:
    """Distinct patients per allergen nature and their share of all allergic patients."""
    everyone = allergies.agg(F.count_distinct("uuid")).scalar()
    return (
        allergies.groupBy("allergen_nature").agg(F.count_distinct("uuid").alias("patients"))
        .select(
            F.coalesce(F.nullif(F.col("allergen_nature"), F.lit("")), F.lit("Unknown")).alias("allergen_nature"),
            "patients",
            pct(F.col("patients"), everyone, 2).alias("share"),
        )
    )


def top_causative_agents(allergies: DataFrame, k: int = 10) -> DataFrame:
    """A11."""
    return st.top_k(allergies, "allergy_description", k)


def severity_distribution(allergies: DataFrame) -> DataFrame:
    """A12."""
    return allergies.groupBy("primary_symptom_severity").agg(F.count(F.lit(1)).alias("count"))


def discovery_trends(allergies: DataFrame) -> DataFrame:
    """Allergies per detection year (0 when undated) and category."""
    year = F.coalesce(F.year("allergy_detection_date"), F.lit(0))
    return allergies.groupBy(year.alias("year"), "category").agg(F.count(F.lit(1)).alias("count"))


def category_distribution(allergies: DataFrame) -> DataFrame:
    """A14."""
    return allergies.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def cross_reactivity(allergies: DataFrame, k: int = 20) -> DataFrame:
    """Allergen pairs of the same patient, counted per pair of records."""
    return pairs.cooccurrence(allergies, "uuid", "allergy_description", k, distinct=False, name="co_occurrence_count")


def nature_severity_matrix(allergies: DataFrame) -> DataFrame:
    """A16."""
    return allergies.groupBy("allergen_nature", F.col("primary_symptom_severity").alias("severity")).agg(
        F.count(F.lit(1)).alias("count")
    )


def age_at_onset(allergies: DataFrame, patients: DataFrame) -> DataFrame:
    """Allergies per decade of age at detection (negative ages keep their decade).

    Allergies are counted per (patient, day) before the join.
    """
    age = years_between(F.col("birth_date"), F.col("allergy_detection_date"))
    return (
        allergies.groupBy("uuid", "allergy_detection_date").agg(F.count(F.lit(1)).alias("n"))
        .join(patients.select("uuid", "birth_date"), "uuid")
        .select(age.alias("age"), "n")
        .where(F.col("age").isNotNull())
        .groupBy(decade(F.col("age")).alias("age_from"), decade_label(F.col("age")).alias("age_group"))
        .agg(F.sum("n").alias("count"))
    )


def pollen_seasonality(allergies: DataFrame) -> DataFrame:
    """Environmental allergies per calendar month and growth over the previous month present.

    The unpartitioned window orders at most 13 aggregated rows.
    """
    monthly = (
        allergies.where(IS_ENVIRONMENTAL)
        .groupBy(F.month("allergy_detection_date").alias("month_number"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    prev = F.lag("count").over(Window.orderBy("month_number"))
    growth = F.round(ratio(F.col("count") - F.col("prev"), F.col("prev")) * 100, 2)
    return (
        monthly.withColumn("prev", prev)
        .select(
            "month_number",
            month_label(F.col("month_number")).alias("month"),
            "count",
            F.when(F.col("prev") > 0, growth).otherwise(F.lit(0.0)).alias("mom_growth_rate"),
        )
    )
