"""Data-quality rules of the data contract, run as Spark jobs.

``validate`` reports ``(entity, rule, column, violations)``. All row-level rules of a table share one
scan and one aggregate; key and reference rules add one aggregate each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.operators.cleaning import membership
from careflow.schemas import KEYS


@dataclass(frozen=True)
class Rules:
    """Constraints of one table."""

    unique: Sequence[Sequence[str]] = ()
    not_null: Sequence[str] = ()
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, key)
    minimum: Mapping[str, float] = field(default_factory=dict)
    allowed: Mapping[str, Sequence[str]] = field(default_factory=dict)
    max_length: Mapping[str, int] = field(default_factory=dict)


# The constraints of the data contract.
RULES: dict[str, Rules] = {
    "patients": Rules(
        unique=[KEYS["patients"]],
        not_null=["uuid", "birth_date", "social_security_number", "first_name"],
        minimum={"family_income": 0},
        max_length={
            "social_security_number": 16, "driver_license_number": 16, "salutation": 8,
            "first_name": 64, "middle_name": 64, "last_name": 64, "doctorate": 32,
            "marital_status": 16, "race": 20, "ethnicity": 16, "gender": 1,
            "patient_birthplace": 255, "geolocated_city": 128, "geolocated_state": 128,
            "geolocated_county": 128, "postal_code": 50,
        },
    ),
    "conditions": Rules(
        unique=[KEYS["conditions"]],
        not_null=["uuid"],
        references={"uuid": ("patients", "uuid")},
        max_length={"fsn_id": 255, "associated_semantics": 100},
    ),
    "encounters": Rules(
        unique=[KEYS["encounters"]],
        not_null=["encounter_id", "uuid"],
        references={"uuid": ("patients", "uuid")},
        max_length={"encounter_type": 100, "encounter_reason_id": 100, "diagnosis_id": 100},
    ),
    "allergies": Rules(
        unique=[KEYS["allergies"]],
        not_null=["uuid", "encounter_id", "allergy_code"],
        references={"uuid": ("patients", "uuid"), "encounter_id": ("encounters", "encounter_id")},
        allowed={
            "coding_system": ["SNOMED-CT", "RxNorm"],
            "primary_symptom_severity": ["MODERATE", "SEVERE", "N/A", "MILD"],
            "secondary_symptom_severity": ["MODERATE", "SEVERE", "N/A", "MILD"],
        },
    ),
    "metrics": Rules(
        not_null=["entity_name", "metric_type", "data"],
        max_length={"entity_name": 64, "metric_type": 64},
    ),
}


# What a column gets that a batch does not have.
DEFAULTS: dict[str, dict[str, object]] = {
    "patients": {"doctorate": "No Doctorate", "marital_status": "Unknown", "family_income": 0},
}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. A key with a NULL part is never a duplicate."""
    named = df
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values without a parent and their rows; rows are counted per value before the join."""
    per_value = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return per_value.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def _row_checks(rules: Rules) -> list[tuple[str, str, Column]]:
    """Rule, column and violation condition; NULL passes all but NOT NULL, as in a SQL CHECK."""
    checks = [("not_null", c, F.col(c).isNull()) for c in rules.not_null]
    checks += [("minimum", c, F.col(c) < low) for c, low in rules.minimum.items()]
    checks += [("allowed", c, ~F.col(c).isin(list(v))) for c, v in rules.allowed.items()]
    checks += [("max_length", c, F.length(c) > n) for c, n in rules.max_length.items()]
    return checks


def row_violations(df: DataFrame, rules: Rules) -> DataFrame:
    """Violating rows per rule, all in one aggregate."""
    checks = _row_checks(rules)
    wide = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
    rows = [
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col(f"c{i}").alias("violations"))
        for i, (r, c, _) in enumerate(checks)
    ]
    return wide.select(F.inline(F.array(*rows)))


def unique_violations(df: DataFrame, entity: str, rules: Rules) -> DataFrame:
    """The number of duplicated keys of each unique rule."""
    found = None
    for keys in rules.unique:
        n = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("violations"))
        part = n.select(F.lit(entity).alias("entity"), F.lit("unique").alias("rule"), F.lit(",".join(keys)).alias("column"), "violations")
        found = part if found is None else found.unionByName(part)
    return found


def validate(
    df: DataFrame, entity: str, rules: Rules | None = None, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """All rules of a table as ``(entity, rule, column, violations)``.

    A unique rule counts duplicated keys; a reference rule counts rows without a parent and runs
    for the parents given in ``tables``.
    """
    rules = rules or RULES[entity]
    parts = []
    if _row_checks(rules):
        parts.append(row_violations(df, rules))
    if rules.unique:
        parts.append(unique_violations(df, entity, rules).drop("entity"))
    for column, (table, key) in rules.references.items():
        if tables and table in tables:
            found = missing_references(df, column, tables[table], key).agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")
            )
            parts.append(found.select(F.lit("reference").alias("rule"), F.lit(column).alias("column"), "violations"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.select(F.lit(entity).alias("entity"), "rule", "column", F.col("violations").cast("bigint").alias("violations"))


def row_rules(df: DataFrame, rules: Rules, tables: Mapping[str, DataFrame] | None = None) -> list[str]:
    """Names (``rule:column``) of the rules that each row of ``df`` is held against: those whose column and, for a reference, table are there."""
    names = [f"{rule}:{column}" for rule, column, _ in _row_checks(rules) if column in df.columns]
    return names + [f"reference:{column}" for column, (table, _) in rules.references.items() if table in (tables or {})]


def with_broken_rules(df: DataFrame, rules: Rules, tables: Mapping[str, DataFrame] | None = None, name: str = "broken") -> DataFrame:
    """``df`` with an array of all rules that a row breaks, by name in the order of the contract; empty for a sound row.

    Conditions on the row itself are filled in by one projection. Each reference to a table given in ``tables`` (unique by its key) is one
    left join with a flag, which leaves sound and broken rows in place; a key that holds a third of the rows is split by
    adaptive execution. A NULL breaks only NOT NULL, as in SQL.
    """
    checks = [F.when(bad, F.lit(f"{rule}:{column}")) for rule, column, bad in _row_checks(rules) if column in df.columns]
    marked, joined = df, False
    for column, (table, key) in rules.references.items():
        if table in (tables or {}):
            flag, joined = f"_known_{column}", True
            known = tables[table].select(F.col(key).alias(column), F.lit(True).alias(flag))
            marked = marked.join(known, column, "left")
            checks.append(F.when(F.col(column).isNotNull() & F.col(flag).isNull(), F.lit(f"reference:{column}")))
    broken = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    out = marked.select(*df.columns, broken.alias(name))
    return out.hint("rebalance") if joined else out


def broken_rule_counts(marked: DataFrame, entity: str, names: Sequence[str], name: str = "broken") -> DataFrame:
    """(entity, rule, column, violations) of the row rules ``names`` from the rows of ``with_broken_rules``, by one aggregate; 0 where none is broken."""
    wide = marked.agg(*[F.count_if(F.array_contains(name, n)).alias(f"c{i}") for i, n in enumerate(names)])
    rows = [
        F.struct(F.lit(n.partition(":")[0]).alias("rule"), F.lit(n.partition(":")[2]).alias("column"), F.col(f"c{i}").alias("violations"))
        for i, n in enumerate(names)
    ]
    return wide.select(F.lit(entity).alias("entity"), F.inline(F.array(*rows)))


def apply_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Column defaults for NULLs."""
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def add_missing_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Columns that ``df`` does not have, with their defaults; a NULL that is there stays, as in an SQL INSERT."""
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in defaults.items() if c not in df.columns})


def cascade_delete(child: DataFrame, removed: DataFrame, key: str = "uuid") -> DataFrame:
    """The child rows left after their parents in ``removed`` are deleted."""
    return membership(child, removed.select(key), key, "left_anti")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column in one pass."""
    names = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("_rows").alias("rows")) for c in names]
    return wide.select(F.inline(F.array(*rows)))


def value_profile(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value of a column."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def column_sketches(df: DataFrame, columns: Sequence[str], lg_k: int = 12) -> DataFrame:
    """One row for each column: (column, rows, nulls, sketch), the sketch of its distinct values having a fixed size whatever their number.

    Sketches of parts (days, files, batches) are merged by ``merged_sketches``, so a profile is kept up to date without reading old rows
    again. Values are sketched as text; a column without values has an empty sketch.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls{i}"), F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"sketch{i}")]
    rows = [
        F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"nulls{i}").alias("nulls"), F.col(f"sketch{i}").alias("sketch")) for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merged_sketches(parts: DataFrame) -> DataFrame:
    """Profiles of parts of a table as one, by column."""
    return parts.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch"))


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct): the number of distinct values, within about 2 percent at the default size and exact for a few."""
    return sketches.select("column", "rows", "nulls", F.hll_sketch_estimate("sketch").alias("distinct"))


def frequent_values(df: DataFrame, column: str, k: int = 10, counters: int = 10_000) -> DataFrame:
    """The ``k`` most frequent values and their counts from a sketch of ``counters`` counters; exact while there are fewer distinct values.

    Beside ``value_profile``, which on a key column gives a row for each row. NULL is a value like others.
    """
    items = df.agg(F.expr(f"approx_top_k(`{column}`, {k}, {counters})").alias("items"))
    return items.select(F.inline("items")).select(F.col("item").alias("value"), "count")


def rows_with_nulls(df: DataFrame, k: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with exactly k NULLs; k = 0 gives the complete records."""
    names = list(columns or df.columns)
    missing = sum((F.col(c).isNull().cast("int") for c in names), F.lit(0))
    return df.where(missing == k)
