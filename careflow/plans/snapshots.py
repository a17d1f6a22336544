"""KPI snapshots of all four entities that are kept up to date batch by batch, without reading old rows again.

What the snapshots of all periods need of the rows is small and can be added up: counts and sums for each date, and the first day of each
patient, practitioner or concept. It is kept in one bucketed table, with the names of the batches in it, so that a
batch is added in one step, once, and its rows are the only ones that are read. Rows must be new; for changed ones drop the state and add all again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.operators import allergies as al
from careflow.operators import conditions as co
from careflow.operators import encounters as en
from careflow.operators import patients as pa
from careflow.sources import store

KEYS = ["kind", "key"]


def _key(*columns: str) -> str:
    """Columns as one text that tells NULL from all values."""
    parts = ", ".join(f"coalesce(concat(length(CAST({c} AS STRING)), '=', CAST({c} AS STRING)), '')" for c in columns)
    return f"concat_ws('|', {parts})"


def encounter_state(encounters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``encounters.facts_by_key``, whose ``key`` is the value after its length, or empty for NULL.

    With ``by``, a column that names the batch of each row, these are the states of several batches, made in one pass: see ``add_batches``.
    """
    return en.facts_by_key(encounters, _key, by)


def _part(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.expr(_key(*keys)).alias("key"), *rows.columns)


def condition_state(conditions: DataFrame) -> DataFrame:
    """A row for each pair of record date and date of abetment (``span``), and for each patient and concept (``concept``)."""
    dates = ["condition_record_date", "date_of_abetment"]
    spans = _part(conditions.groupBy(*dates).agg(F.count(F.lit(1)).alias("n")), "span", *dates)
    return spans.unionByName(_part(co.concept_dates(conditions), "concept", "uuid", "medical_concepts"), allowMissingColumns=True)


def patient_state(patients: DataFrame) -> DataFrame:
    """A row for each make-up of a patient that the KPIs tell apart (``cell``), and for each income and life (``income``)."""
    cells = _part(pa.counted_patients(patients), "cell", "birth_date", "death_date", "gender", "married", "doctor")
    incomes = _part(pa.counted_incomes(patients), "income", "family_income", "birth_date", "death_date")
    return cells.unionByName(incomes, allowMissingColumns=True)


def allergy_state(allergies: DataFrame, patients: DataFrame, encounters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of new allergies, patients and encounters: a row for each make-up of an allergy (``allergy``), each patient and code (``code``), each life
    (``life``) and each patient's day with a visit (``visit``). With ``by``, the states of several batches as in ``encounter_state``."""
    counted = al.counted_allergies(allergies, by)
    parts = [
        _part(counted, "allergy", *[c for c in counted.columns if c not in ("n", *by)]),
        _part(al.code_dates(allergies, by), "code", "uuid", "allergy_code"),
        _part(al.counted_lives(patients, by), "life", "birth_date", "death_date"),
        _part(al.visit_days(encounters, by).distinct(), "visit", "uuid", "day"),
    ]
    state = parts[0]
    for part in parts[1:]:
        state = state.unionByName(part, allowMissingColumns=True)
    return state


def _plus(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a, b).isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def _either(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a, b).isNotNull(), F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))


#: How a column of two states becomes one; all others hold the same in both or are missing in one.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    **dict.fromkeys([*en.ADDENDS, "n", "income", "incomes"], _plus), **dict.fromkeys(["first_on", "cured_on", "on", "drug_on"], F.least),
    **dict.fromkeys(["resolved", "drug"], _either),
}


def combined(state: DataFrame, more: DataFrame) -> DataFrame:
    """Two states as one. Rows of ``state`` stay where its buckets are; ``more`` comes to them."""
    new = more.select(*[F.col(c).alias(f"_new_{c}") for c in more.columns])
    joined = state.join(new, (F.col("kind") == F.col("_new_kind")) & (F.col("key") == F.col("_new_key")), "full_outer")
    return joined.select(*[RULES.get(c, F.coalesce)(F.col(c), F.col(f"_new_{c}")).alias(c) for c in state.columns])


def add_batch(spark: SparkSession, table: str, batch: str, state: DataFrame, buckets: int | None = None) -> bool:
    """Add the state of new rows under the name of their batch to that in a catalog table; whether this was still to be done.

    A batch that is in the table already changes nothing and is not read, nor does one change anything that stops half-way.
    """
    there = spark.catalog.tableExists(table)
    if there and not spark.table(table).where((F.col("kind") == "batch") & (F.col("key") == batch)).isEmpty():
        return False
    mark = spark.createDataFrame([("batch", batch)], "kind string, key string")
    state = state.unionByName(mark, allowMissingColumns=True)
    if there:
        state = combined(spark.table(table), state.repartition(store.describe(spark, table)["num_buckets"], *KEYS))
    store.replace(spark, table, state, KEYS, buckets)
    return True


def add_batches(spark: SparkSession, table: str, states: DataFrame, batches: Sequence[str], batch_col: str = "batch") -> None:
    """Add the states of several batches, told apart by ``batch_col``, one after another; they are made and written once, and read from there."""
    path = store.scratch_path(spark, "batch-states")
    states.write.parquet(path)
    made = spark.read.schema(states.schema).parquet(path)
    for batch in batches:
        add_batch(spark, table, batch, made.where(F.col(batch_col) == batch).drop(batch_col))


def encounter_snapshots(state: DataFrame, as_of: dt.date) -> DataFrame:
    """The rows of ``encounters.encounter_kpis``, from a state alone, by one aggregate."""
    return en.kpis_of_facts(state.where("kind <> 'batch'"), as_of, key="key <> ''")


def condition_snapshots(state: DataFrame, as_of: dt.date) -> DataFrame:
    """The rows of ``conditions.condition_kpis``, from a state alone."""
    return co.kpis_of_spans(state.where("kind = 'span'"), state.where("kind = 'concept'"), as_of)


def patient_snapshots(state: DataFrame, as_of: dt.date, status: str = "as_of") -> DataFrame:
    """The rows of ``patients.patient_kpis``, from a state alone."""
    return pa.kpis_of_cells(state.where("kind = 'cell'"), state.where("kind = 'income'"), as_of, status)


def allergy_snapshots(state: DataFrame, as_of: dt.date) -> DataFrame:
    """The rows of ``allergies.allergy_kpis``, from a state alone."""
    codes = state.where("kind = 'code'").select("uuid", "allergy_code", "on", "drug_on", "drug")
    people = al.patients_of_codes(codes, state.where("kind = 'visit'").select("uuid", "day"))
    return al.kpis_of_counts(state.where("kind = 'allergy'"), people, state.where("kind = 'life'"), as_of)
