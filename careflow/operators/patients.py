"""Patient analytics: KPI snapshots, demographic ratios, survival, inequality and trends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.functions.columns import day, pct, ratio, rounded, trunc, whole_years
from careflow.functions.periods import Period, aggregate_points, by_period
from careflow.operators import statistics as st

NO_DOCTORATE = "no doctorate"  # compared case-insensitively: both spellings occur


def is_alive() -> Column:
    return F.col("death_date").isNull()


def population(p: Period) -> str:
    """Registered at the snapshot: born by ``ref`` and not dead before it."""
    if p.current:
        return "true"
    return f"(coalesce(birth_date <= {p.date}, false) AND (death_date IS NULL OR death_date >= {p.date}))"


def counted_patients(patients: DataFrame) -> DataFrame:
    """What the patient KPIs depend on and how many patients have it: dates, sex, marriage and doctorate, with the sum and number of incomes."""
    rows = patients.select(
        "birth_date", "death_date", "gender", F.expr("coalesce(marital_status = 'M', false)").alias("married"),
        F.expr(f"coalesce(lower(doctorate) <> '{NO_DOCTORATE}', false)").alias("doctor"), F.col("family_income").cast("bigint").alias("family_income"),
    )
    return rows.groupBy(*rows.columns[:-1]).agg(F.count(F.lit(1)).alias("n"), F.sum("family_income").alias("income"), F.count("family_income").alias("incomes"))


def counted_incomes(patients: DataFrame) -> DataFrame:
    """(family_income, birth_date, death_date, n)."""
    return patients.groupBy(F.col("family_income").cast("bigint").alias("family_income"), "birth_date", "death_date").agg(F.count(F.lit(1)).alias("n"))


def patient_kpis(patients: DataFrame, as_of: dt.date, status: str = "as_of") -> DataFrame:
    """The eight patient KPIs per period.

    ``status='as_of'`` judges who is alive, and how old, at the reference date. ``'recorded'``
    takes today's death status and age for the past population, as the source reports do. Empty
    periods are left out. The median is the lower middle value, taken exactly from the counts of
    distinct incomes; everything else is one scan and one aggregation.
    """
    people = patients.select("birth_date", "death_date", "gender", "family_income", "marital_status", "doctorate")
    cells = people.withColumns({
        "n": F.lit(1).cast("bigint"), "married": F.col("marital_status") == "M", "doctor": F.lower("doctorate") != NO_DOCTORATE,
        "income": F.col("family_income").cast("bigint"), "incomes": F.col("family_income").isNotNull().cast("bigint"),
    })
    return kpis_of_cells(cells, cells, as_of, status)


def kpis_of_cells(cells: DataFrame, incomes: DataFrame, as_of: dt.date, status: str = "as_of") -> DataFrame:
    """P1-P9 from the rows of ``counted_patients`` and ``counted_incomes``, or of the patients themselves, counted once each."""
    if status not in ("as_of", "recorded"):
        raise ValueError(f"unknown status: {status}")

    def at_ref(p: Period) -> bool:
        return status == "as_of" and not p.current

    def is_living(p: Period) -> str:
        still = f"(death_date IS NULL OR death_date > {p.date})" if at_ref(p) else "death_date IS NULL"
        return f"({population(p)} AND {still})"

    def number(which: str) -> str:
        return f"coalesce(sum(IF({which}, n, 0L)), 0L)"

    def measures(p: Period) -> dict[str, str]:
        inside, alive = population(p), is_living(p)
        days = f"datediff({p.date if at_ref(p) else f"DATE'{as_of}'"}, birth_date)"
        return {
            "total": number(inside),
            "alive": number(alive),
            "males": number(f"{inside} AND gender = 'M'"),
            "females": number(f"{inside} AND gender = 'F'"),
            "mean_income": f"try_divide(sum(IF({alive}, income, NULL)), sum(IF({alive}, incomes, NULL)))",
            "age": f"sum(IF({alive}, n * {days}, NULL)) / 365.25D / sum(IF({alive} AND {days} IS NOT NULL, n, NULL))",
            "married": number(f"{inside} AND married"),
            "doctors": number(f"{inside} AND doctor"),
        }

    people = by_period(incomes, as_of, lambda p: {"people": number(is_living(p))}, ["family_income"])
    median = st.lower_median(people.where("people > 0"), "family_income", ["period"], "people", "median_income")
    stats = by_period(cells, as_of, measures).where("total > 0")
    return stats.join(median, "period", "left").select("period", *_kpi_columns())


def _kpi_columns() -> list[Column]:
    total = F.col("total")
    return [
        total.alias("total_patients"),
        trunc(pct(F.col("alive"), total)).alias("active_patient_rate"),
        trunc(pct(F.col("males"), F.greatest(F.col("females"), F.lit(1)))).alias("gender_balance_ratio"),
        trunc(F.col("mean_income")).alias("mean_family_income"),
        trunc(F.col("median_income")).alias("median_family_income"),
        rounded(F.col("age"), 1).alias("avg_patient_age"),
        pct(F.col("married"), total, 1).alias("married_rate"),
        pct(F.col("doctors"), total, 1).alias("higher_education_rate"),
    ]


def age_at_end(as_of: dt.date) -> Column:
    """Whole years at death, or at ``as_of`` for the living."""
    return whole_years(F.col("birth_date"), F.coalesce(F.col("death_date"), day(as_of)))


def economic_dependence_ratio(patients: DataFrame, as_of: dt.date) -> DataFrame:
    """P10."""
    living = patients.where(is_alive())
    age = whole_years(F.col("birth_date"), day(as_of))
    return st.dependency_ratio(living, age, 20, 64, "economic_dependence_ratio")


def cultural_diversity_score(patients: DataFrame) -> DataFrame:
    """P11."""
    return st.simpson_index(patients.where(is_alive()), "race", name="cultural_diversity_score")


def mortality_rate(patients: DataFrame) -> DataFrame:
    """P12."""
    return patients.agg(_mortality())


def _mortality() -> Column:
    return pct(F.count("death_date"), F.count(F.lit(1)), 2).alias("mortality_rate")


def age_wealth_correlation(patients: DataFrame, as_of: dt.date) -> DataFrame:
    """Pearson correlation of whole-year age and income; 0.0 where undefined.

    Written as covariance over deviations: the built-in ``corr`` raises for a constant column in
    ANSI mode.
    """
    return patients.agg(_age_wealth(as_of))


def _age_wealth(as_of: dt.date) -> Column:
    age, income = age_at_end(as_of).cast("double"), F.col("family_income").cast("double")
    x, y = F.when(income.isNotNull(), age), F.when(age.isNotNull(), income)
    r = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.round(r, 3).alias("age_wealth_correlation")


def income_inequality_index(patients: DataFrame, rank_mode: str = "row") -> DataFrame:
    """Gini index of family income; ``rank_mode='dense'`` gives the source reports' figure."""
    return st.gini(patients, "family_income", rank_mode, "income_inequality_index")


def patient_metrics(patients: DataFrame, as_of: dt.date, rank_mode: str = "row") -> DataFrame:
    """P10-P14 as (metric, value) rows; P12 and P13 are one scan."""
    parts = [
        economic_dependence_ratio(patients, as_of),
        cultural_diversity_score(patients),
        patients.agg(_mortality(), _age_wealth(as_of)),
        income_inequality_index(patients, rank_mode),
    ]
    rows = [
        p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in p.columns]))) for p in parts
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def ten_year_trends(patients: DataFrame, as_of: dt.date, years: int = 10) -> DataFrame:
    """Dependence, diversity and mortality for each of the past ``years`` years.

    One scan: conditional aggregates per (race, year), summed over races. Age is taken at 31
    December; a year without population yields zeros.
    """

    def measures(y: int) -> dict[str, str]:
        born = f"year(birth_date) <= {y}"
        inside = f"({born} AND (death_date IS NULL OR year(death_date) > {y}))"
        age = f"CAST(datediff(DATE'{y}-12-31', birth_date) / 365.25D AS INT)"
        return {
            "n": f"count_if({inside})",
            "working": f"count_if({inside} AND {age} BETWEEN 20 AND 64)",
            "deaths": f"count_if(year(death_date) = {y})",
            "exposed": f"count_if({born} AND (death_date IS NULL OR year(death_date) >= {y}))",
        }

    points = [(str(as_of.year - i), measures(as_of.year - i)) for i in range(1, years + 1)]
    per_race = aggregate_points(patients, points, "year", ["race"])
    n, working = F.sum("n"), F.sum("working")
    return per_race.groupBy("year").agg(
        trunc(ratio(n - working, F.greatest(working, F.lit(1))) * 100).alias("economic_dependence"),
        st.simpson_of_counts(F.col("n")).alias("cultural_diversity"),
        pct(F.sum("deaths"), F.greatest(F.sum("exposed"), F.lit(1)), 2).alias("mortality_rate"),
    )


def economic_dependence_trend(patients: DataFrame, as_of: dt.date) -> DataFrame:
    return ten_year_trends(patients, as_of).select("year", "economic_dependence")


def cultural_diversity_trend(patients: DataFrame, as_of: dt.date) -> DataFrame:
    return ten_year_trends(patients, as_of).select("year", "cultural_diversity")


def mortality_rate_trend(patients: DataFrame, as_of: dt.date) -> DataFrame:
    return ten_year_trends(patients, as_of).select("year", "mortality_rate")


SURVIVAL_BINS = list(range(5, 90, 5))


def survival_trend(patients: DataFrame, as_of: dt.date, at_risk: str = "start") -> DataFrame:
    """Actuarial survival by gender over the five-year bins 5..85."""
    known = patients.where(F.col("gender").isin("M", "F") & F.col("birth_date").isNotNull())
    return st.life_table(
        known, age_at_end(as_of), F.col("death_date").isNotNull(), "gender", SURVIVAL_BINS, at_risk
    )


def demographic_entropy(patients: DataFrame) -> DataFrame:
    """Shannon entropy of race per city, with the race counts."""
    return st.shannon_entropy(patients, "geolocated_city", "race", "demographic_entropy")


def wealth_trajectory(patients: DataFrame, as_of: dt.date) -> DataFrame:
    """P20: average income and income per year of age, per age band 0-5, 6-10, ... 81-85."""
    age = F.col("age")
    band = F.when(age <= 5, F.lit(0)).otherwise(F.floor((age - 1) / F.lit(5))).cast("int")
    stats = (
        patients.select(age_at_end(as_of).alias("age"), "family_income")
        .where(age.between(0, 85))
        .groupBy(band.alias("band"))
        .agg(
            F.avg("family_income").alias("income"),
            F.avg(F.ceil(F.try_divide(F.col("family_income"), age))).alias("velocity"),
        )
    )
    low = F.when(F.col("band") > 0, F.col("band") * 5 + 1).otherwise(F.lit(0))
    spine = patients.sparkSession.range(17).select(F.col("id").cast("int").alias("band"))
    return spine.join(stats, "band", "left").select(
        "band",
        F.concat(low.cast("string"), F.lit("-"), (F.col("band") * 5 + 5).cast("string")).alias("age_band"),
        trunc(F.col("income")).alias("avg_income"),
        trunc(F.col("velocity")).alias("avg_wealth_velocity"),
    )


def mortality_hazard(patients: DataFrame) -> DataFrame:
    """Deaths per patient by race and equal-width income bin."""
    return st.hazard_by_bins(patients, "family_income", F.col("death_date").isNotNull(), "race")
