"""Clinical views over star-schema order tables, for running the operators on such data.

customer is the patient, an order line an encounter and a condition record, a part the concept.
``(l_orderkey, l_linenumber)`` is not unique, so the line id adds the part and the supplier.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.schemas import Tables

AS_OF = dt.date(2001, 6, 30)


# Schemas of the source tables (given, so that no file footer is read to plan a query).
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = source(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    span = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(day).alias("first_on"), F.max(day).alias("last_on"))
    nation = source(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    key = F.col("c_custkey")
    return (
        source(spark, sf_dir, "customer")
        .join(span, "c_custkey", "left")
        .join(nation, "c_nationkey", "left")
        .select(
            key.cast("string").alias("uuid"),
            F.date_sub("first_on", ((key * 37) % 90 * 365).cast("int")).alias("birth_date"),
            F.when(F.col("last_on") < F.lit("2001-01-01").cast("date"), F.col("last_on")).alias("death_date"),
            F.when(key % 2 == 0, "M").otherwise("F").alias("gender"),
            F.when(key % 3 == 0, "M").otherwise("S").alias("marital_status"),
            F.when(key % 7 == 0, "PhD").otherwise("No doctorate").alias("doctorate"),
            F.col("c_mktsegment").alias("race"),
            F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 10).cast("bigint").alias("family_income"),
            F.concat(F.col("n_name"), F.lit("-"), (key % 4).cast("string")).alias("geolocated_city"),
            F.col("n_name").alias("geolocated_state"),
        )
    )


def _lines(spark: SparkSession, sf_dir: str, parts_first: bool = True) -> DataFrame:
    """Lines with their orders and parts. With ``parts_first``, what a view filters by part, and the part key where no more is read of it, does
    not travel to the orders; otherwise the key travels in place of the part's name, and all columns of parts are read from one shuffle."""
    orders = source(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority"
    )
    parts = source(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand", "p_size")
    lines = source(spark, sf_dir, "lineitem")
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey") if parts_first else lines.join(orders, "l_orderkey").join(parts, "l_partkey")


def _line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    record, ship = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return _lines(spark, sf_dir, parts_first=False).select(
        record.alias("condition_record_date"),
        F.when(ship >= record, ship).alias("date_of_abetment"),
        F.col("o_custkey").cast("string").alias("uuid"),
        _line_id().alias("encounter_uuid"),
        F.col("l_partkey").cast("string").alias("fsn_id"),
        F.col("p_name").alias("medical_concepts"),
        F.when(F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM"), "disorder").otherwise("finding").alias("associated_semantics"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("l_linenumber") % 4) * 6)
    base = F.col("l_extendedprice")
    return _lines(spark, sf_dir).select(
        _line_id().alias("encounter_id"),
        start.alias("visit_start"),
        (start + F.make_interval(hours=F.col("l_quantity").cast("int"))).alias("visit_end"),
        F.col("o_custkey").cast("string").alias("uuid"),
        F.when(F.col("l_suppkey") % 50 != 0, F.col("l_suppkey").cast("string")).alias("practioner_id"),
        F.col("o_orderpriority").alias("encounter_type"),
        F.col("p_name").alias("encounter_reason"),
        base.alias("visiting_base_fees"),
        (base * (F.lit(1.0) + F.col("l_tax"))).alias("visting_total_fees"),
        F.when(F.col("l_linenumber") != 7, base * (F.lit(1.0) - F.col("l_discount")) * F.lit(0.8)).alias("coverage"),
    )


def allergies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest line of each (customer, part) with a part size divisible by 3."""
    record, ship = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    lines = _lines(spark, sf_dir).where(F.col("p_size") % 3 == 0)
    first = lines.groupBy("o_custkey", "l_partkey").agg(
        F.min(F.struct(
            record.alias("record"), "l_orderkey", "l_linenumber", "l_suppkey", ship.alias("ship"),
            "p_name", "p_brand", "p_size",
        )).alias("r")
    ).select("o_custkey", "l_partkey", "r.*")
    severity = lambda n: F.element_at(F.array(*[F.lit(s) for s in ("MILD", "MODERATE", "SEVERE", "N/A")]), (n % 4 + 1).cast("int"))
    size, line = F.col("p_size"), F.col("l_linenumber")
    return first.select(
        F.col("record").alias("allergy_detection_date"),
        F.when(F.col("ship") >= F.col("record"), F.col("ship")).alias("allergy_cure_date"),
        F.col("o_custkey").cast("string").alias("uuid"),
        _line_id().alias("encounter_id"),
        F.col("l_partkey").alias("allergy_code"),
        F.when(F.col("p_name").startswith("red"), "Penicillin").otherwise(F.col("p_name")).alias("allergy_description"),
        F.when(size % 9 == 0, "medication").when(size % 9 == 3, "food").otherwise("environment").alias("category"),
        F.when(size % 4 == 0, "Anaphylaxis").otherwise("Rash").alias("primary_symptom_description"),
        severity(line).alias("primary_symptom_severity"),
        severity(line + 1).alias("secondary_symptom_severity"),
        F.when(F.substring("p_brand", -1, 1).cast("int") % 2 == 1, "drug").otherwise("substance").alias("allergen_nature"),
    )


def event_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as encounters with heavy-tailed fees."""
    return source(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("encounter_id"),
        F.col("event_type").alias("encounter_reason"),
        F.col("value").alias("visting_total_fees"),
    )


VIEWS = {"patients": patients, "conditions": conditions, "encounters": encounters, "allergies": allergies}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Tables:
    """The named views (all by default)."""
    wanted = names or tuple(VIEWS)
    return Tables(**{n: view(spark, sf_dir) if n in wanted else None for n, view in VIEWS.items()})


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state spine: the nations."""
    return source(spark, sf_dir, "nation").select(F.col("n_name").alias("geolocated_state"))


# The same views in SQL, for checking.
VIEWS_SQL = {
    "patients": """
        SELECT CAST(c_custkey AS VARCHAR) AS uuid,
               first_on - CAST((c_custkey * 37) % 90 * 365 AS INTEGER) AS birth_date,
               CASE WHEN last_on < DATE '2001-01-01' THEN last_on END AS death_date,
               CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
               CASE WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'S' END AS marital_status,
               CASE WHEN c_custkey % 7 = 0 THEN 'PhD' ELSE 'No doctorate' END AS doctorate,
               c_mktsegment AS race,
               CAST(floor(greatest(c_acctbal, 0.0::DOUBLE) * 10) AS BIGINT) AS family_income,
               n_name || '-' || CAST(c_custkey % 4 AS VARCHAR) AS geolocated_city,
               n_name AS geolocated_state
        FROM customer
        LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_on, max(CAST(o_orderdate AS DATE)) AS last_on
                   FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
        LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "lines": """
        SELECT *, CAST(o_orderdate AS DATE) AS record, CAST(l_shipdate AS DATE) AS ship,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "conditions": """
        SELECT record AS condition_record_date,
               CASE WHEN ship >= record THEN ship END AS date_of_abetment,
               CAST(o_custkey AS VARCHAR) AS uuid, line_id AS encounter_uuid,
               CAST(l_partkey AS VARCHAR) AS fsn_id, p_name AS medical_concepts,
               CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'disorder' ELSE 'finding' END AS associated_semantics
        FROM lines""",
    "encounters": """
        SELECT line_id AS encounter_id,
               o_orderdate + to_hours((l_linenumber % 4) * 6) AS visit_start,
               o_orderdate + to_hours((l_linenumber % 4) * 6) + to_hours(CAST(l_quantity AS INTEGER)) AS visit_end,
               CAST(o_custkey AS VARCHAR) AS uuid,
               CASE WHEN l_suppkey % 50 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS practioner_id,
               o_orderpriority AS encounter_type, p_name AS encounter_reason,
               l_extendedprice AS visiting_base_fees,
               l_extendedprice * (1.0::DOUBLE + l_tax) AS visting_total_fees,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice * (1.0::DOUBLE - l_discount) * 0.8::DOUBLE END AS coverage
        FROM lines""",
    "allergies": """
        SELECT record AS allergy_detection_date, CASE WHEN ship >= record THEN ship END AS allergy_cure_date,
               CAST(o_custkey AS VARCHAR) AS uuid, line_id AS encounter_id, l_partkey AS allergy_code,
               CASE WHEN p_name LIKE 'red%' THEN 'Penicillin' ELSE p_name END AS allergy_description,
               CASE p_size % 9 WHEN 0 THEN 'medication' WHEN 3 THEN 'food' ELSE 'environment' END AS category,
               CASE WHEN p_size % 4 = 0 THEN 'Anaphylaxis' ELSE 'Rash' END AS primary_symptom_description,
               ['MILD', 'MODERATE', 'SEVERE', 'N/A'][l_linenumber % 4 + 1] AS primary_symptom_severity,
               ['MILD', 'MODERATE', 'SEVERE', 'N/A'][(l_linenumber + 1) % 4 + 1] AS secondary_symptom_severity,
               CASE WHEN CAST(right(p_brand, 1) AS INTEGER) % 2 = 1 THEN 'drug' ELSE 'substance' END AS allergen_nature
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_partkey
                                           ORDER BY record, l_orderkey, l_linenumber, l_suppkey, ship) AS rn
              FROM lines WHERE p_size % 3 = 0)
        WHERE rn = 1""",
    "event_fees": """
        SELECT CAST(event_id AS VARCHAR) AS encounter_id, event_type AS encounter_reason, value AS visting_total_fees
        FROM events""",
    "states": "SELECT n_name AS geolocated_state FROM nation",
    "periods": """
        SELECT * FROM (VALUES ('current', DATE '2001-06-30', TRUE), ('last_week', DATE '2001-06-23', FALSE),
                              ('last_month', DATE '2001-05-31', FALSE), ('last_year', DATE '2000-06-30', FALSE))
               AS t(period, ref, cur)""",
}
_NEEDS = {"conditions": ["lines"], "encounters": ["lines"], "allergies": ["lines"]}


def with_views(views: list[str], body: str, extra: str = "") -> str:
    """``body`` with the named views (and ``extra`` CTEs) in front."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    ctes = [f"{n} AS ({VIEWS_SQL[n]})" for n in names]
    if extra:
        ctes.append(extra)
    return f"WITH RECURSIVE {', '.join(ctes)}\n{body}" if ctes else body
