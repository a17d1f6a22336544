from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from careflow.operators import cleaning as cl
from careflow.operators import encounters as en
from careflow.operators import reshape as rs
from careflow.plans import proxy
from careflow.plans.proxy import AS_OF, source, with_views
from careflow.queries import encounters as qe
from careflow.queries.registry import query
from careflow.schemas import CSV_COLUMNS
from careflow.sources import files, store

LOADED_AT = dt.datetime(2001, 6, 30, 12, 0, 0)


def _fsn(df):
    """Fully specified names built from part names and types."""
    return df.withColumn("fsn", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))


@query("s1_csv_scan", with_views(["conditions"], """
SELECT condition_record_date, date_of_abetment, uuid, encounter_uuid, fsn_id, medical_concepts, associated_semantics FROM conditions"""))
def s1_csv_scan(spark, sf_dir):
    """The conditions written as headerless CSV files, then scanned and cleaned."""
    path = store.scratch_path(spark, "conditions-csv")
    fsn = F.concat("medical_concepts", F.lit(" ("), "associated_semantics", F.lit(")"))
    proxy.conditions(spark, sf_dir).select(
        "condition_record_date", "date_of_abetment", "uuid", "encounter_uuid", F.lit("SNOMED-CT"), "fsn_id", fsn
    ).write.csv(path, header=False)
    return cl.clean_conditions(files.read_entity(spark, path, "conditions"))


@query("s1_malformed_rows", with_views(["conditions"], """
SELECT CASE WHEN associated_semantics = 'finding' THEN 'malformed' ELSE 'read' END AS kind,
       CASE WHEN associated_semantics = 'finding'
            THEN concat_ws(',', condition_record_date, coalesce(CAST(date_of_abetment AS VARCHAR), ''), uuid, encounter_uuid, 'SNOMED-CT', fsn_id, medical_concepts || ', severe (finding)')
            ELSE medical_concepts END AS text, count(*) AS rows
FROM conditions GROUP BY ALL"""))
def s1_malformed_rows(spark, sf_dir):
    """The conditions as lines of text, those of findings with an unquoted comma in the concept: they have a field too many."""
    path = store.scratch_path(spark, "conditions-lines")
    concept = F.when(F.col("associated_semantics") == "finding", F.concat("medical_concepts", F.lit(", severe (finding)"))).otherwise(
        F.concat("medical_concepts", F.lit(" (disorder)"))
    )
    fields = ["condition_record_date", F.coalesce(F.col("date_of_abetment").cast("string"), F.lit("")), "uuid", "encounter_uuid", F.lit("SNOMED-CT"), "fsn_id", concept]
    proxy.conditions(spark, sf_dir).select(F.concat_ws(",", *fields).alias("value")).write.text(path)
    lines = files.read_lines(spark, path, "conditions")
    read = cl.clean_conditions(files.well_formed(lines)).select(F.lit("read").alias("kind"), F.col("medical_concepts").alias("text"))
    both = read.unionByName(files.malformed(lines).select(F.lit("malformed").alias("kind"), F.col("line").alias("text")))
    return both.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("rows"))


@query("s2_keyed_upsert", """
SELECT o_orderkey, o_orderstatus, round(o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END, 2) AS o_totalprice,
       CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version
FROM orders""")
def s2_keyed_upsert(spark, sf_dir):
    """All orders stored, then the finished ones upserted (twice) with a new price."""
    table = f"{store.scratch_database(spark, 'upserts')}.orders"
    orders = source(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice"), F.lit(1).alias("version"))
    finished = orders.where("o_orderstatus = 'F'").withColumns({"o_totalprice": F.col("o_totalprice") + 100.0, "version": F.lit(2)})
    for batch in (orders, finished, finished):
        store.upsert(spark, table, batch, ["o_orderkey"], "version")
    return store.read_store(spark, table).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("s2_upsert_null_keys", """
WITH rows AS (SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS k, o_custkey, o_totalprice FROM orders)
SELECT k, o_custkey, CASE WHEN k IS NULL THEN NULL ELSE 2 END AS note, o_totalprice FROM rows WHERE k IS NOT NULL
UNION ALL SELECT DISTINCT k, o_custkey, NULL::INTEGER, o_totalprice FROM rows WHERE k IS NULL""")
def s2_upsert_null_keys(spark, sf_dir):
    """Rows without a key are kept apart, and merge only as whole rows; a later batch lacks a column, and a batch comes twice."""
    table = f"{store.scratch_database(spark, 'upserts')}.orders"
    key = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("k")
    orders = source(spark, sf_dir, "orders").select(key, "o_custkey", "o_totalprice", F.lit(1).alias("at"))
    noted = orders.where("k IS NOT NULL").withColumn("note", F.lit(2))
    for batch in (noted, orders.withColumn("at", F.lit(2)), orders.withColumn("at", F.lit(2))):
        store.upsert(spark, table, batch, ["k"], "at")
    return store.read_store(spark, table).drop("at")


def _stored_kpis(spark, sf_dir):
    path = store.scratch_path(spark, "metrics")
    e = proxy.encounters(spark, sf_dir)
    # all results follow from small facts, which are made in one pass over the encounters
    facts_path = store.scratch_path(spark, "facts")
    en.facts_by_key(e, "CAST({} AS STRING)".format, counted=["encounter_type", "encounter_reason"]).write.parquet(facts_path)
    facts = spark.read.parquet(facts_path)
    kpis = en.kpis_of_facts(facts, AS_OF)
    causes = rs.top_rows(en.counts_of_facts(facts, "encounter_reason"), 10, F.desc("count"), "encounter_reason")
    types = {"encounters_by_type": en.counts_of_facts(facts, "encounter_type"), "top_causes": causes}
    store.write_metrics({"kpis": kpis}, path, "encounters", "Kpis", LOADED_AT)
    store.write_metrics(types, path, "encounters", "Metrics", LOADED_AT)
    store.write_metrics({"kpis": kpis}, path, "encounters", "Kpis", LOADED_AT)  # replaces its own key only
    return path, kpis.schema


@query("s3_result_upsert", with_views(["encounters", "periods"], "SELECT * FROM encounter_kpis", qe.KPIS_SQL))
def s3_result_upsert(spark, sf_dir):
    """Encounter KPIs written to the metrics store twice, read back as typed rows."""
    path, schema = _stored_kpis(spark, sf_dir)
    return store.restore_metric(store.read_metrics(spark, path, "encounters", "Kpis"), "kpis", schema.simpleString())


@query("s4_result_documents", with_views(["encounters"], """
SELECT 'encounters' AS entity_name, 'kpis' AS section, 'kpis' AS metric, 4::BIGINT AS documents
UNION ALL SELECT 'encounters', 'metrics', 'encounters_by_type', count(DISTINCT encounter_type) FROM encounters
UNION ALL SELECT 'encounters', 'metrics', 'top_causes', least(count(DISTINCT encounter_reason), 10) FROM encounters"""))
def s4_result_documents(spark, sf_dir):
    path, _ = _stored_kpis(spark, sf_dir)
    documents = store.dashboard(spark, path, "encounters")
    return documents.groupBy("entity_name", "section", "metric").agg(F.count("data").alias("documents"))


@query("s5_full_scan", "SELECT * FROM customer")
def s5_full_scan(spark, sf_dir):
    return files.read_table(spark, f"{sf_dir}/customer.parquet")


@query("s6_narrow_projection", "SELECT o_custkey, o_orderkey FROM orders")
def s6_narrow_projection(spark, sf_dir):
    return files.read_table(spark, f"{sf_dir}/orders.parquet", ["o_custkey", "o_orderkey"])


@query("s7_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def s7_preview(spark, sf_dir):
    return files.preview(source(spark, sf_dir, "customer"), 100, ["c_custkey"])


@query("s8_missing_fees", with_views(["encounters"], """
SELECT encounter_type, count(*) FILTER (coalesce(coverage, 0) = 0) AS uncovered, round(avg(coalesce(coverage, 0)), 2) AS avg_coverage
FROM encounters GROUP BY encounter_type"""))
def s8_missing_fees(spark, sf_dir):
    filled = en.fill_missing_fees(proxy.encounters(spark, sf_dir))
    return filled.groupBy("encounter_type").agg(
        F.count_if(F.col("coverage") == 0).alias("uncovered"), F.round(F.avg("coverage"), 2).alias("avg_coverage")
    )


@query("s9_parsed_dates", """
SELECT try_cast(d AS DATE) AS d, try_cast(t AS TIMESTAMP) AS t, count(*) AS count
FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
             strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders) GROUP BY 1, 2""")
def s9_parsed_dates(spark, sf_dir):
    text = source(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("t"),
    )
    return files.parse_dates(text, ["d"], ["t"]).groupBy("d", F.col("t").cast("timestamp_ntz").alias("t")).agg(F.count(F.lit(1)).alias("count"))


@query("t1_rename_positional", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer")
def t1_rename_positional(spark, sf_dir):
    return cl.rename_positional(source(spark, sf_dir, "customer"), ["key", "name", "_", "balance", "_"])


@query("t2_iso_dates", """
SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS count FROM orders GROUP BY 1""")
def t2_iso_dates(spark, sf_dir):
    text = source(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return text.groupBy(cl.iso_date(F.col("d")).alias("d")).agg(F.count(F.lit(1)).alias("count"))


@query("t3_strip_trailing_digits", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+$', '') AS name FROM customer")
def t3_strip_trailing_digits(spark, sf_dir):
    return source(spark, sf_dir, "customer").select("c_custkey", cl.strip_trailing_digits(F.col("c_name")).alias("name"))


@query("t4_salutation", with_views(["patients"], """
SELECT uuid, CASE WHEN gender = 'M' THEN 'Mr.' ELSE 'Ms.' END AS salutation FROM patients"""))
def t4_salutation(spark, sf_dir):
    return proxy.patients(spark, sf_dir).select("uuid", cl.salutation(F.col("gender")).alias("salutation"))


def _text_rows(df, entity: str):
    """Rows as the text columns of an entity's file: those that ``df`` lacks are empty."""
    return df.select(*[
        (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(f"c{i}") for i, c in enumerate(CSV_COLUMNS[entity])
    ])


@query("t5_default_fill", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE 'Unknown' END AS marital_status, TIMESTAMP '2001-06-30 12:00:00' AS created_at FROM customer""")
def t5_default_fill(spark, sf_dir):
    """Defaults and the load time."""
    df = source(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("marital_status"))
    return df.fillna({"marital_status": cl.PATIENT_DEFAULTS["marital_status"]}).withColumn("created_at", F.lit(LOADED_AT).cast("timestamp_ntz"))


@query("t5_clean_patients", """
SELECT CAST(c_custkey AS VARCHAR) AS uuid, DATE '1950-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS birth_date,
       CASE WHEN c_custkey % 5 = 0 THEN DATE '2000-02-29' END AS death_date, 'S' || CAST(c_custkey AS VARCHAR) AS social_security_number,
       CASE WHEN c_custkey % 2 = 0 THEN 'Mr.' ELSE 'Ms.' END AS salutation, regexp_replace(c_name, '[0-9]+$', '') AS first_name,
       'Doe' AS last_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE 'Unknown' END AS marital_status,
       CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS postal_code,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 1000 END AS family_income, TIMESTAMP '2001-06-30 12:00:00' AS created_at
FROM customer""")
def t5_clean_patients(spark, sf_dir):
    """The whole cleaner over customers written as the text of a patients file."""
    key = F.col("c_custkey")
    raw = source(spark, sf_dir, "customer").select(
        key.alias("uuid"), F.date_add(F.lit("1950-01-01").cast("date"), (key % 9000).cast("int")).alias("birth_date"),
        F.when(key % 5 == 0, "2000-02-29").when(key % 5 == 1, "never").alias("death_date"), F.concat(F.lit("S"), key.cast("string")).alias("social_security_number"),
        F.col("c_name").alias("first_name"), F.lit("Doe77").alias("last_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("marital_status"),
        F.when(key % 2 == 0, "M").otherwise("F").alias("gender"), F.col("c_nationkey").alias("postal_code"),
        F.when(key % 3 == 0, "much").otherwise((key * 1000).cast("string")).alias("family_income"),
    )
    clean = cl.clean_patients(_text_rows(raw, "patients"), LOADED_AT)
    return clean.select(
        "uuid", "birth_date", "death_date", "social_security_number", "salutation", "first_name", "last_name", "marital_status", "gender",
        "postal_code", F.col("family_income").cast("bigint").alias("family_income"), F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query("t9_clean_encounters", """
SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id, o_orderdate AS visit_start,
       CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2001-06-30 00:00:00' ELSE o_orderdate + INTERVAL 1 HOUR END AS visit_end,
       CAST(o_custkey AS VARCHAR) AS uuid, o_orderpriority AS encounter_type,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS visting_total_fees, 12.5::DOUBLE AS coverage
FROM orders""")
def t9_clean_encounters(spark, sf_dir):
    """Open visits end at the reference date, unreadable fees become NULL."""
    start = F.col("o_orderdate").cast("timestamp")
    raw = source(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("encounter_id"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("visit_start"),
        F.when(F.col("o_orderstatus") != "F", F.date_format(start + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("visit_end"),
        F.col("o_custkey").alias("uuid"), F.col("o_orderpriority").alias("encounter_type"),
        F.when(F.col("o_orderstatus") == "O", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("visting_total_fees"), F.lit("12.50").alias("coverage"),
    )
    clean = cl.clean_encounters(_text_rows(raw, "encounters"), AS_OF)
    return clean.select(
        "encounter_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("visit_start", "visit_end")], "uuid", "encounter_type", "visting_total_fees", "coverage"
    )


@query("t14_clean_allergies", """
SELECT DATE '2000-01-01' + CAST(p_size AS INTEGER) AS allergy_detection_date, CAST(p_partkey AS VARCHAR) AS uuid,
       p_partkey * 1000000000 AS allergy_code, p_name AS allergy_description, p_type AS allergen_nature,
       CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE -1 END AS primary_symptom_code, p_name AS primary_symptom_description,
       CASE WHEN p_size % 3 = 0 THEN 'MILD' ELSE 'N/A' END AS primary_symptom_severity
FROM part""")
def t14_clean_allergies(spark, sf_dir):
    """Names split, codes beyond 32 bits kept, sentinels filled."""
    raw = _fsn(source(spark, sf_dir, "part")).select(
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size").cast("int")).alias("allergy_detection_date"), F.col("p_partkey").alias("uuid"),
        (F.col("p_partkey") * 1000000000).alias("allergy_code"), F.col("fsn").alias("allergy_description"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("none").alias("primary_symptom_code"),
        F.col("fsn").alias("primary_symptom_description"), F.when(F.col("p_size") % 3 == 0, "MILD").alias("primary_symptom_severity"),
    )
    clean = cl.clean_allergies(_text_rows(raw, "allergies"))
    return clean.select(
        "allergy_detection_date", "uuid", "allergy_code", "allergy_description", "allergen_nature", "primary_symptom_code",
        "primary_symptom_description", "primary_symptom_severity",
    )


@query("t6_postal_code", "SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS postal_code FROM customer")
def t6_postal_code(spark, sf_dir):
    return source(spark, sf_dir, "customer").select("c_custkey", cl.postal_code(F.col("c_nationkey")).alias("postal_code"))


@query("t8_split_concept", """
SELECT p_partkey, p_name AS medical_concepts, p_type AS associated_semantics FROM part""")
def t8_split_concept(spark, sf_dir):
    return cl.split_concept(_fsn(source(spark, sf_dir, "part")).select("p_partkey", "fsn"), "fsn")


@query("t9_close_open_visits", with_views(["conditions"], """
SELECT uuid, coalesce(date_of_abetment, DATE '2001-06-30')::TIMESTAMP AS visit_end, count(*) AS count FROM conditions GROUP BY 1, 2"""))
def t9_close_open_visits(spark, sf_dir):
    end = cl.close_open_visits(F.try_to_timestamp(F.col("date_of_abetment").cast("string")), AS_OF).cast("timestamp_ntz")
    return proxy.conditions(spark, sf_dir).groupBy("uuid", end.alias("visit_end")).agg(F.count(F.lit(1)).alias("count"))


@query("t10_numeric_casts", """
SELECT o_orderkey, try_cast(CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE '12.50' END AS DOUBLE) AS fee,
       try_cast(CAST(o_orderkey AS VARCHAR) || '000000000' AS BIGINT) AS code FROM orders""")
def t10_numeric_casts(spark, sf_dir):
    """Unreadable fees and codes beyond 64 bits become NULL, long codes survive."""
    text = source(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "n/a").otherwise("12.50").alias("fee"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("000000000")).alias("code"),
    )
    return text.select("o_orderkey", F.col("fee").try_cast("double").alias("fee"), F.col("code").try_cast("bigint").alias("code"))


@query("t11_split_allergen", """
SELECT p_partkey, p_name AS allergy_description, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'drug' END AS allergen_nature FROM part""")
def t11_split_allergen(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.col("fsn")).otherwise(F.col("p_name"))
    return cl.split_allergen(_fsn(source(spark, sf_dir, "part")).select("p_partkey", text.alias("allergy_description")))


@query("t12_split_symptoms", """
SELECT p_partkey, p_name AS primary_symptom_description, p_type AS primary_symptom_nature,
       p_brand AS secondary_symptom_description, '' AS secondary_symptom_nature FROM part""")
def t12_split_symptoms(spark, sf_dir):
    df = _fsn(source(spark, sf_dir, "part")).select(
        "p_partkey", F.col("fsn").alias("primary_symptom_description"), F.col("p_brand").alias("secondary_symptom_description")
    )
    return cl.split_symptoms(df)


@query("t14_allergy_sentinels", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE -1 END AS primary_symptom_code,
       CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'N/A' END AS primary_symptom_severity FROM part""")
def t14_allergy_sentinels(spark, sf_dir):
    df = source(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).alias("primary_symptom_code"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("primary_symptom_severity"),
    )
    return cl.fill_allergy_sentinels(df)


@query("t15_known_parents", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def t15_known_parents(spark, sf_dir):
    solvent = source(spark, sf_dir, "customer").where("c_acctbal > 0")
    orders = source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return cl.keep_known_parents(orders, solvent, "o_custkey", "c_custkey")


@query("t16_orphan_count", """
SELECT count(*) AS orphan_rows, count(DISTINCT o_custkey) AS orphan_keys FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def t16_orphan_count(spark, sf_dir):
    solvent = source(spark, sf_dir, "customer").where("c_acctbal > 0")
    return cl.orphan_count(source(spark, sf_dir, "orders"), solvent, "o_custkey", "c_custkey")


@query("t17_clean_medications", """
SELECT o_orderdate AS medication_start, o_orderdate + to_hours(CAST(l_quantity AS INTEGER)) AS medication_end,
       CAST(o_custkey AS VARCHAR) AS uuid, CAST(l_orderkey AS VARCHAR) AS encounter_id, l_partkey AS rxnorm_medication_id,
       'item ' || CAST(l_partkey AS VARCHAR) AS medication, l_extendedprice AS medication_cost, l_discount AS amount_covered_under_claim,
       CAST(l_quantity AS BIGINT) AS quantity, l_tax AS net_cost,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE 100000000000 + l_suppkey END AS condition_id, l_linestatus AS condition_treated
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def t17_clean_medications(spark, sf_dir):
    orders = source(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    text = lambda c: c.cast("string")
    end = F.col("o_orderdate") + F.make_interval(hours=F.col("l_quantity").cast("int"))
    raw = source(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(
        text(F.col("o_orderdate")).alias("a"), text(end).alias("b"), text(F.col("o_custkey")).alias("c"), F.lit("payer").alias("d"),
        text(F.col("l_orderkey")).alias("e"), text(F.col("l_partkey")).alias("f"),
        F.concat(F.lit("item "), text(F.col("l_partkey"))).alias("g"), text(F.col("l_extendedprice")).alias("h"),
        text(F.col("l_discount")).alias("i"), text(F.col("l_quantity").cast("bigint")).alias("j"), text(F.col("l_tax")).alias("k"),
        F.when(F.col("l_returnflag") == "R", "none").otherwise(text(F.lit(100000000000) + F.col("l_suppkey"))).alias("l"),
        F.col("l_linestatus").alias("m"),
    )
    clean = cl.clean_medications(raw)
    return clean.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("medication_start", "medication_end")})


@query("t18_clean_procedures", """
SELECT o_orderdate + INTERVAL '5 hours 30 minutes' AS procedure_start, o_orderdate + INTERVAL '6 hours 30 minutes' AS procedure_end,
       CAST(o_custkey AS VARCHAR) AS uuid, CAST(o_orderkey AS VARCHAR) AS encounter_id, o_orderkey AS procedure_id,
       o_orderpriority AS procedure_performed, o_totalprice AS cost_of_procedure,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 700000000000 + o_orderkey END AS diagnosis_id, o_orderstatus AS diagnosis
FROM orders""")
def t18_clean_procedures(spark, sf_dir):
    text = lambda c: c.cast("string")
    o = source(spark, sf_dir, "orders")
    raw = o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("b"),
        text(F.col("o_custkey")).alias("c"), text(F.col("o_orderkey")).alias("d"), F.lit("SNOMED-CT").alias("e"),
        text(F.col("o_orderkey")).alias("f"), F.col("o_orderpriority").alias("g"), text(F.col("o_totalprice")).alias("h"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(text(F.lit(700000000000) + F.col("o_orderkey"))).alias("i"),
        F.col("o_orderstatus").alias("j"),
    )
    clean = cl.clean_procedures(raw)
    return clean.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("procedure_start", "procedure_end")})


@query("t19_shift_timestamps", "SELECT o_orderkey, o_orderdate + INTERVAL '5 hours 30 minutes' AS o_orderdate FROM orders")
def t19_shift_timestamps(spark, sf_dir):
    return cl.shift_timestamps(source(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@query("t20_open_end", with_views(["conditions"], """
SELECT coalesce(CAST(date_of_abetment AS VARCHAR), 'Undergoing') AS event_end, count(*) AS count FROM conditions GROUP BY 1"""))
def t20_open_end(spark, sf_dir):
    end = cl.fill_open_end(F.col("date_of_abetment"))
    return proxy.conditions(spark, sf_dir).groupBy(end.alias("event_end")).agg(F.count(F.lit(1)).alias("count"))


@query("t21_alternate_allergies", with_views(["allergies"], """
SELECT allergy_detection_date AS recorded_date, uuid, encounter_id, allergy_code AS causative_agent_id, NULL::VARCHAR AS code_system,
       allergy_description AS causative_agent, NULL::VARCHAR AS agent_aim, category AS agent_class, NULL::BIGINT AS primary_reaction_id,
       primary_symptom_description AS primary_reaction, primary_symptom_severity AS primary_reaction_severity,
       NULL::BIGINT AS symptom_id, NULL::VARCHAR AS symptom_observed, secondary_symptom_severity AS symptom_severity FROM allergies"""))
def t21_alternate_allergies(spark, sf_dir):
    missing = {
        "coding_system": F.lit(None).cast("string"), "allergy_type": F.lit(None).cast("string"),
        "primary_symptom_code": F.lit(None).cast("bigint"), "secondary_symptom_code": F.lit(None).cast("bigint"),
        "secondary_symptom_description": F.lit(None).cast("string"),
    }
    return cl.alternate_allergies(proxy.allergies(spark, sf_dir).withColumns(missing))
