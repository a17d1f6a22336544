"""Load run: entity files -> cleaned, referentially intact, upserted tables and the rows that were refused."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.operators import cleaning, quality
from careflow.schemas import KEYS, Tables
from careflow.sources import files, store

LOADED = ["patients", "conditions", "encounters", "allergies"]  # parents before children


def require_utc(spark: SparkSession) -> None:
    """Dates of timestamps are those of UTC in every table and metric; another session time zone would shift them."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC, not {zone}")


def load_entity(
    spark: SparkSession, entity: str, csv_path: str, database: str, as_of: dt.date, loaded_at: dt.datetime,
    tables: Mapping[str, DataFrame] | None = None, header: bool = False,
) -> DataFrame:
    """Read, clean, refuse what breaks the contract, upsert the rest; returns the quality report.

    The file is parsed and cleaned once: the cleaned batch, each row with all the rules it breaks, is checkpointed in the shared folder for the report, the
    refused rows and the upsert. A row is refused for a NULL in a mandatory column, a value below its minimum, outside its list or too long, or a parent that is
    not in ``tables`` (references to tables that are not given are not checked); a line for having the wrong number of fields (``malformed``). The
    report counts the violations of each rule, and under the rule ``rejected`` the refused rows by what they broke.
    """
    rules, tables = quality.RULES[entity], tables or {}
    lines = files.read_lines(spark, csv_path, entity, header)
    clean = cleaning.cleaner(entity, as_of, loaded_at)(files.well_formed(lines))
    defaults = quality.DEFAULTS.get(entity, {}) | {"created_at": F.lit(loaded_at).cast("timestamp")}
    clean = quality.add_missing_columns(clean, defaults)
    store.shared_dir(spark)
    marked = quality.with_broken_rules(clean, rules, tables).checkpoint()
    malformed = files.malformed(lines).select(F.lit(["malformed:line"]).alias("broken"), "line")
    refused = marked.where(F.size("broken") > 0).withColumn("line", F.lit(None).cast("string"))
    refused = refused.unionByName(malformed, allowMissingColumns=True).checkpoint()
    write_rejects(spark, rejects_table(database, entity), refused, loaded_at)
    store.upsert(spark, f"{database}.{entity}", marked.where(F.size("broken") == 0).drop("broken"), KEYS[entity], "created_at")
    rejected = refused.select(F.explode("broken").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("violations"))
    n_lines = refused.agg(F.count("line").alias("violations"))
    return (
        quality.broken_rule_counts(marked, entity, quality.row_rules(clean, rules, tables))
        .unionByName(quality.unique_violations(marked, entity, rules))
        .unionByName(n_lines.select(F.lit(entity).alias("entity"), F.lit("malformed").alias("rule"), F.lit("line").alias("column"), "violations"))
        .unionByName(rejected.select(F.lit(entity).alias("entity"), F.lit("rejected").alias("rule"), "column", "violations"))
    )


def rejects_table(database: str, entity: str) -> str:
    return f"{database}.{entity}_rejects"


def write_rejects(spark: SparkSession, table: str, refused: DataFrame, loaded_at: dt.datetime) -> None:
    """The refused rows of a load as its partition of the table of rejects, so that a repeated load replaces them."""
    load = loaded_at.strftime("%Y%m%dT%H%M%S%f")
    rows = refused.withColumn("rejected_at", F.lit(loaded_at).cast("timestamp"))
    if not spark.catalog.tableExists(table):
        rows.withColumn("load", F.lit(load)).limit(0).write.format("parquet").partitionBy("load").saveAsTable(table)
    columns = [c for c in spark.table(table).columns if c != "load"]
    name = "_refused_" + uuid.uuid4().hex
    rows.select(*columns).createOrReplaceTempView(name)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (load = '{load}') SELECT * FROM {name}")
    spark.catalog.dropTempView(name)


def rejects(spark: SparkSession, database: str, entity: str) -> DataFrame | None:
    """What loads have refused, one row for each rule that a row or line broke, with ``rule``, ``line`` and ``rejected_at``; None before the first load."""
    table = rejects_table(database, entity)
    if not spark.catalog.tableExists(table):
        return None
    rows = spark.table(table).drop("load")
    return rows.select(*[c for c in rows.columns if c != "broken"], F.explode("broken").alias("rule"))


def run_load(
    spark: SparkSession, csv_dir: str, database: str, as_of: dt.date, loaded_at: dt.datetime, header: bool = False
) -> DataFrame:
    """All entities in order into tables of ``database``, each checked against the tables loaded before it; returns the combined quality report."""
    require_utc(spark)
    reports: list[DataFrame] = []
    tables: dict[str, DataFrame] = {}
    for entity in LOADED:
        reports.append(load_entity(spark, entity, f"{csv_dir}/{entity}.csv", database, as_of, loaded_at, tables, header))
        tables[entity] = store.read_keys(spark, f"{database}.{entity}", *KEYS[entity])
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def stored_tables(spark: SparkSession, database: str) -> Tables:
    return Tables(**{e: store.read_store(spark, f"{database}.{e}") for e in LOADED})
