"""Entity schemas, keys and the fixed vocabularies of the data contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _D, _TS, _L, _F = T.StringType(), T.DateType(), T.TimestampType(), T.LongType(), T.DoubleType()

# ---------------------------------------------------------------------------------------
# Column order of the entity CSV files ("_" marks a position that is dropped).
# ---------------------------------------------------------------------------------------
CSV_COLUMNS: dict[str, list[str]] = {
    "patients": [
        "uuid", "birth_date", "death_date", "social_security_number", "driver_license_number",
        "passport_number", "salutation", "first_name", "middle_name", "last_name", "doctorate",
        "_", "marital_status", "race", "ethnicity", "gender", "patient_birthplace",
        "current_address", "geolocated_city", "geolocated_state", "geolocated_county", "_",
        "postal_code", "latitude", "longitude", "_", "_", "family_income",
    ],
    "conditions": [
        "condition_record_date", "date_of_abetment", "uuid", "encounter_uuid", "_", "fsn_id", "fsn",
    ],
    "encounters": [
        "encounter_id", "visit_start", "visit_end", "uuid", "hospital_id", "practioner_id", "_",
        "encounter_type", "encounter_reason_id", "encounter_reason", "visiting_base_fees",
        "visting_total_fees", "coverage", "diagnosis_id", "diagnosis",
    ],
    "allergies": [
        "allergy_detection_date", "allergy_cure_date", "uuid", "encounter_id", "allergy_code",
        "coding_system", "allergy_description", "allergy_type", "category",
        "primary_symptom_code", "primary_symptom_description", "primary_symptom_severity",
        "secondary_symptom_code", "secondary_symptom_description", "secondary_symptom_severity",
    ],
    "medications": [
        "medication_start", "medication_end", "uuid", "_", "encounter_id",
        "rxnorm_medication_id", "medication", "medication_cost", "amount_covered_under_claim",
        "quantity", "net_cost", "condition_id", "condition_treated",
    ],
    "procedures": [
        "procedure_start", "procedure_end", "uuid", "encounter_id", "_", "procedure_id",
        "procedure_performed", "cost_of_procedure", "diagnosis_id", "diagnosis",
    ],
}

# Cleaned tables: only the columns that are not strings need a type here.
_TYPED: dict[str, dict[str, T.DataType]] = {
    "patients": {
        "birth_date": _D, "death_date": _D, "family_income": _L,
        "latitude": T.DecimalType(10, 8), "longitude": T.DecimalType(11, 8),
    },
    "conditions": {"condition_record_date": _D, "date_of_abetment": _D},
    "encounters": {
        "visit_start": _TS, "visit_end": _TS, "visiting_base_fees": _F,
        "visting_total_fees": _F, "coverage": _F,
    },
    "allergies": {
        "allergy_detection_date": _D, "allergy_cure_date": _D, "allergy_code": _L,
        "primary_symptom_code": _L, "secondary_symptom_code": _L,
    },
    "medications": {
        "medication_start": _TS, "medication_end": _TS, "rxnorm_medication_id": _L,
        "medication_cost": _F, "amount_covered_under_claim": _F, "quantity": _L,
        "net_cost": _F, "condition_id": _L,
    },
    "procedures": {
        "procedure_start": _TS, "procedure_end": _TS, "procedure_id": _L,
        "cost_of_procedure": _F, "diagnosis_id": _L,
    },
}

# Columns that cleaning replaces or adds.
_REPLACED = {"conditions": {"fsn": ["medical_concepts", "associated_semantics"]}}
_ADDED: dict[str, list[tuple[str, T.DataType]]] = {
    "patients": [("created_at", _TS)],
    "allergies": [("allergen_nature", _S), ("primary_symptom_nature", _S), ("secondary_symptom_nature", _S)],
}

ENTITIES = tuple(CSV_COLUMNS)


def unique_names(names: list[str]) -> list[str]:
    """Positional names made unique: the i-th dropped position becomes ``_i``."""
    return [f"_{i}" if n == "_" else n for i, n in enumerate(names)]


def raw_schema(entity: str) -> T.StructType:
    """All-string schema of a CSV file; typing happens in cleaning with ``try_`` casts."""
    return T.StructType([T.StructField(n, _S) for n in unique_names(CSV_COLUMNS[entity])])


def table_schema(entity: str) -> T.StructType:
    """Schema of the cleaned table."""
    fields: list[T.StructField] = []
    for name in CSV_COLUMNS[entity]:
        if name == "_":
            continue
        for out in _REPLACED.get(entity, {}).get(name, [name]):
            fields.append(T.StructField(out, _TYPED[entity].get(out, _S)))
    fields += [T.StructField(n, t) for n, t in _ADDED.get(entity, [])]
    return T.StructType(fields)


# Conflict keys of the keyed upserts.
KEYS: dict[str, list[str]] = {
    "patients": ["uuid"],
    "conditions": ["uuid", "encounter_uuid", "fsn_id", "condition_record_date"],
    "encounters": ["encounter_id"],
    "allergies": ["uuid", "allergy_code"],
}

# Labels of calendar months.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Symptom severities in display order.
SEVERITIES = ["MILD", "MODERATE", "SEVERE", "N/A"]

# Allergy categories.
ALLERGY_CATEGORIES = ["environment", "food", "medication"]

# The 50 states of the geographic reports.
US_STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut",
    "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas",
    "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota",
    "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas",
    "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
]

# KPIs for which a fall is an improvement; for all others a rise is.
LOWER_IS_BETTER = [
    "avg_patient_age",
    "current_active_burden", "patient_complexity_score", "average_time_to_cure",
    "admission_rate_last_30_days", "total_diagnoses", "chronic_condition_burden",
    "total_allergic_population", "active_allergy_percentage", "severe_allergy_incidence_rate",
    "allergic_patient_rate", "allergy_related_readmission_rate", "poly_allergen_patient_rate",
    "drug_hypersensitivity_rate",
    "average_encounter_duration_hours", "average_patient_out_of_pocket", "average_base_fee",
    "average_practitioner_load",
]


@dataclass(frozen=True)
class Tables:
    """The four analysed tables, as DataFrames of the schemas above."""

    patients: object
    conditions: object
    encounters: object
    allergies: object
