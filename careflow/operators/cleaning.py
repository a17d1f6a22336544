"""Cleaning of the raw (all-string) entity tables into the typed tables of ``schemas``.

Every step is a column expression, so a cleaned table is one projection over its source.
Untrusted text goes through ``try_`` conversions: bad values become NULL and show up in the
quality report instead of failing the job.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.functions.columns import coded_name, concept_and_semantics
from careflow.schemas import CSV_COLUMNS, table_schema, unique_names

# Defaults and sentinels of the cleaned tables.
PATIENT_DEFAULTS = {
    "passport_number": "N/A", "middle_name": "N/A", "doctorate": "No doctorate", "marital_status": "Unknown",
}
SYMPTOM_TEXTS = [
    "primary_symptom_severity", "primary_symptom_description", "primary_symptom_nature",
    "secondary_symptom_severity", "secondary_symptom_description", "secondary_symptom_nature",
]
ALLERGY_DEFAULTS = {"primary_symptom_code": -1, "secondary_symptom_code": -1, **{c: "N/A" for c in SYMPTOM_TEXTS}}
SHIFT = "INTERVAL 5 HOURS 30 MINUTES"
UNDERGOING = "Undergoing"


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Name columns by position and drop the ``_`` positions."""
    return df.toDF(*unique_names(list(names))).select(*[n for n in names if n != "_"])


def iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` text to date; anything else becomes NULL."""
    return F.try_to_date(c, "yyyy-MM-dd")


def strip_trailing_digits(c: Column) -> Column:
    """T3."""
    return F.regexp_replace(c, "[0-9]+$", "")


def salutation(gender: Column) -> Column:
    """T4."""
    return F.when(gender == "M", "Mr.").otherwise("Ms.")


def postal_code(c: Column) -> Column:
    """Five digits with leading zeros; longer codes are kept whole."""
    text = c.cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def split_concept(df: DataFrame, column: str) -> DataFrame:
    """``Concept (semantics)`` into ``medical_concepts`` and ``associated_semantics``."""
    concept, semantics = concept_and_semantics(F.col(column))
    return df.withColumns({"medical_concepts": concept, "associated_semantics": semantics}).drop(column)


def close_open_visits(end: Column, as_of: dt.date) -> Column:
    """A visit without a readable end closes at ``as_of``."""
    return F.coalesce(end, F.lit(as_of).cast("timestamp"))


def split_allergen(df: DataFrame) -> DataFrame:
    """Description and nature of the allergen; an empty nature is 'drug'."""
    name, nature = coded_name(F.col("allergy_description"))
    return df.withColumns({
        "allergy_description": name,
        "allergen_nature": F.when(F.length(nature) == 0, "drug").otherwise(nature),
    })


def split_symptoms(df: DataFrame) -> DataFrame:
    """Description and nature of both symptoms."""
    out: dict[str, Column] = {}
    for which in ("primary", "secondary"):
        name, nature = coded_name(F.col(f"{which}_symptom_description"))
        out[f"{which}_symptom_description"] = name
        out[f"{which}_symptom_nature"] = nature
    return df.withColumns(out)


def fill_allergy_sentinels(df: DataFrame) -> DataFrame:
    """T14."""
    return df.fillna({c: v for c, v in ALLERGY_DEFAULTS.items() if c in df.columns})


def membership(child: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of ``child`` with a key list; neither side is repeated.

    A key that holds a third of all rows makes one large partition of ``child``, which adaptive execution splits at the measured
    size, equal rows too; the last step, which deals the rows out anew at a balanced size, leaves it free to, whatever follows.
    """
    return child.join(keys.select(key), key, how).select(*child.columns).hint("rebalance")


def keep_known_parents(child: DataFrame, parents: DataFrame, key: str = "uuid", parent_key: str = "uuid") -> DataFrame:
    """Rows whose key exists among the parents."""
    return membership(child, parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def orphan_count(child: DataFrame, parents: DataFrame, key: str = "uuid", parent_key: str = "uuid") -> DataFrame:
    """Rows, and distinct keys, without a parent. Rows are counted per key before the join."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")
    )


def shift_timestamps(df: DataFrame, columns: Sequence[str], interval: str = SHIFT) -> DataFrame:
    """Move timestamps to local time; the result stays a typed timestamp."""
    return df.withColumns({c: F.col(c) + F.expr(interval) for c in columns})


def fill_open_end(c: Column, label: str = UNDERGOING) -> Column:
    """Text of an end date, or the label while it is open."""
    return F.coalesce(c.cast("string"), F.lit(label))


def alternate_allergies(allergies: DataFrame) -> DataFrame:
    """The agent/reaction view of allergies."""
    return allergies.select(
        F.col("allergy_detection_date").alias("recorded_date"),
        "uuid", "encounter_id",
        F.col("allergy_code").alias("causative_agent_id"),
        F.col("coding_system").alias("code_system"),
        F.col("allergy_description").alias("causative_agent"),
        F.col("allergy_type").alias("agent_aim"),
        F.col("category").alias("agent_class"),
        F.col("primary_symptom_code").alias("primary_reaction_id"),
        F.col("primary_symptom_description").alias("primary_reaction"),
        F.col("primary_symptom_severity").alias("primary_reaction_severity"),
        F.col("secondary_symptom_code").alias("symptom_id"),
        F.col("secondary_symptom_description").alias("symptom_observed"),
        F.col("secondary_symptom_severity").alias("symptom_severity"),
    )


def _typed(df: DataFrame, entity: str) -> DataFrame:
    """Columns in table order; text is converted by ``try_cast`` to the table's types."""
    fields = table_schema(entity).fields
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def _named(raw: DataFrame, entity: str) -> DataFrame:
    return rename_positional(raw, CSV_COLUMNS[entity])


def _timestamps(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in columns})


def clean_patients(raw: DataFrame, loaded_at: dt.datetime) -> DataFrame:
    """T1-T7."""
    df = _named(raw, "patients")
    out = {c: iso_date(F.col(c)) for c in ("birth_date", "death_date")}
    out |= {c: strip_trailing_digits(F.col(c)) for c in ("first_name", "middle_name", "last_name")}
    out |= {
        "salutation": salutation(F.col("gender")),
        "postal_code": postal_code(F.col("postal_code")),
        "created_at": F.lit(loaded_at).cast("timestamp"),
    }
    return _typed(df.withColumns(out).fillna(PATIENT_DEFAULTS), "patients")


def clean_conditions(raw: DataFrame) -> DataFrame:
    """T1, T2, T8."""
    df = split_concept(_named(raw, "conditions"), "fsn")
    dates = ("condition_record_date", "date_of_abetment")
    return _typed(df.withColumns({c: iso_date(F.col(c)) for c in dates}), "conditions")


def clean_encounters(raw: DataFrame, as_of: dt.date) -> DataFrame:
    """T1, T9, T10."""
    df = _timestamps(_named(raw, "encounters"), "visit_start", "visit_end")
    df = df.withColumn("visit_end", close_open_visits(F.col("visit_end"), as_of))
    return _typed(df, "encounters")


def clean_allergies(raw: DataFrame) -> DataFrame:
    """T1, T2, T11-T14."""
    df = split_symptoms(split_allergen(_named(raw, "allergies")))
    dates = ("allergy_detection_date", "allergy_cure_date")
    df = df.withColumns({c: iso_date(F.col(c)) for c in dates})
    return fill_allergy_sentinels(_typed(df, "allergies"))


def clean_medications(raw: DataFrame) -> DataFrame:
    """Clinical codes exceed 32 bits and are kept as 64-bit integers."""
    return _typed(_timestamps(_named(raw, "medications"), "medication_start", "medication_end"), "medications")


def clean_procedures(raw: DataFrame) -> DataFrame:
    """T18."""
    times = ("procedure_start", "procedure_end")
    df = _timestamps(_named(raw, "procedures"), *times)
    return _typed(shift_timestamps(df, times), "procedures")


def cleaner(entity: str, as_of: dt.date, loaded_at: dt.datetime) -> Callable[[DataFrame], DataFrame]:
    return {
        "patients": lambda raw: clean_patients(raw, loaded_at),
        "conditions": clean_conditions,
        "encounters": lambda raw: clean_encounters(raw, as_of),
        "allergies": clean_allergies,
        "medications": clean_medications,
        "procedures": clean_procedures,
    }[entity]
