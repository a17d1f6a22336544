"""CSV scan, cleaning, quality rules, stores and the two runs, end to end on small files."""

from __future__ import annotations

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from careflow.operators import cleaning as cl, quality as qu
from careflow.plans import analytics, etl
from careflow.schemas import CSV_COLUMNS, ENTITIES, KEYS, raw_schema, table_schema
from careflow.sources import files, store
from conftest import date, one, rows

AS_OF = dt.date(2020, 6, 30)
LOADED_AT = dt.datetime(2020, 6, 30, 12)

PATIENT = [
    "u1", "1990-01-02", "", "999-11-2222", "S1", "", "", "Ann12", "Bea3x4", "Doe99", "", "", "M", "white", "nonhispanic", "F",
    "Birthplace", "1 Main St", "Boston", "Massachusetts", "Suffolk", "25", "2134", "42.12345678", "-71.00000001", "0", "0", "54321",
]


def patient_row(uuid, **change):
    names = CSV_COLUMNS["patients"]
    row = list(PATIENT)
    row[0] = uuid
    for k, v in change.items():
        row[names.index(k)] = v
    return row


FILES = {
    "patients": [
        patient_row("u1"), patient_row("u2", gender="M", postal_code="10001", birth_date="02/03/1990", doctorate="PhD"),
        patient_row("u3", family_income="-5", death_date="2019-05-01"),
    ],
    "conditions": [
        ["2020-01-01", "2020-01-11", "u1", "e1", "SNOMED", "444814009", "Viral sinusitis (disorder)"],
        ["2020-02-01", "", "u1", "e1", "SNOMED", "73595000", "Stress (finding) (finding)"],
        ["2020-02-01", "", "ghost", "e9", "SNOMED", "73595000", "Stress (finding)"],
        ["not a date", "", "u2", "e2", "SNOMED", "1", "Plain"],
    ],
    "encounters": [
        ["e1", "2020-01-01T08:00:00Z", "2020-01-01T09:30:00Z", "u1", "h1", "d1", "p", "wellness", "10", "Cold", "100.5", "120.25", "20", "5", "Flu"],
        ["e2", "2020-02-01T08:00:00Z", "", "u2", "h1", "d1", "p", "urgent", "", "", "100.5", "n/a", "", "", ""],
        ["e3", "2020-02-01T08:00:00Z", "", "ghost", "h1", "d1", "p", "urgent", "", "", "1", "1", "1", "", ""],
    ],
    "allergies": [
        ["2020-01-01", "", "u1", "e1", "7980", "RxNorm", "Penicillin V", "allergy", "medication", "271807003", "Eruption of skin (disorder)", "MILD", "", "", ""],
        ["2020-01-02", "2020-02-02", "u1", "e1", "300000000000", "SNOMED-CT", "Grass (substance)", "allergy", "environment", "", "", "", "39579001", "Anaphylaxis (disorder)", "SEVERE"],
        ["2020-01-03", "", "u2", "e2", "5", "Other", "Mould", "allergy", "environment", "1", "Rash", "TERRIBLE", "", "", ""],
    ],
}


def write_csv(folder, header=False):
    for entity, lines in FILES.items():
        head = [",".join(f"h{i}" for i in range(len(lines[0])))] if header else []
        (folder / f"{entity}.csv").write_text("\n".join(head + [",".join(r) for r in lines]) + "\n")
    return str(folder)


@pytest.fixture(scope="module", params=[False, True], ids=["headerless", "header"])
def raw(request, spark, tmp_path_factory):
    folder = write_csv(tmp_path_factory.mktemp("csv"), request.param)
    return lambda e: files.read_entity(spark, f"{folder}/{e}.csv", e, header=request.param)


def test_schemas_agree_with_csv_positions():
    assert {e: len(raw_schema(e).fields) for e in ENTITIES} == {
        "patients": 28, "conditions": 7, "encounters": 15, "allergies": 15, "medications": 13, "procedures": 10,
    }
    for entity, keys in KEYS.items():
        assert set(keys) <= set(table_schema(entity).fieldNames())


def test_clean_patients(raw):
    got = {r.uuid: r for r in cl.clean_patients(raw("patients"), LOADED_AT).collect()}
    p = got["u1"]
    assert (p.first_name, p.middle_name, p.last_name) == ("Ann", "Bea3x", "Doe")
    assert (p.salutation, got["u2"].salutation) == ("Ms.", "Mr.")
    assert (p.postal_code, got["u2"].postal_code) == ("02134", "10001")
    assert (p.passport_number, p.doctorate, got["u2"].doctorate) == ("N/A", "No doctorate", "PhD")
    assert p.birth_date == date("1990-01-02") and p.death_date is None
    assert got["u2"].birth_date is None  # not an ISO date
    assert got["u3"].death_date == date("2019-05-01")
    assert str(p.longitude) == "-71.00000001" and p.family_income == 54321
    assert p.created_at == LOADED_AT


def test_clean_conditions(raw):
    got = rows(cl.clean_conditions(raw("conditions")).select("uuid", "condition_record_date", "medical_concepts", "associated_semantics"), "uuid", "condition_record_date")
    assert got == [
        ("ghost", date("2020-02-01"), "Stress", "finding"),
        ("u1", date("2020-01-01"), "Viral sinusitis", "disorder"),
        ("u1", date("2020-02-01"), "Stress (finding)", "finding"),
        ("u2", None, "Plain", ""),
    ]


def test_concepts_end_at_the_last_parenthesis(spark):
    texts = ["Injury (crush) of hand (disorder)", "a (b (c))", "Plain", None, "x (y) z", "open (", ""]
    df = cl.split_concept(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, fsn string"), "fsn")
    got = [tuple(r)[-2:] for r in df.select("i", "medical_concepts", "associated_semantics").orderBy("i").collect()]
    assert got == [("Injury (crush) of hand", "disorder"), ("a (b", "c"), ("Plain", ""), (None, None), ("x", "y"), ("open", ""), ("", "")]


def test_clean_encounters(raw):
    got = {r.encounter_id: r for r in cl.clean_encounters(raw("encounters"), AS_OF).collect()}
    assert got["e1"].visit_end == dt.datetime(2020, 1, 1, 9, 30) and got["e1"].visting_total_fees == 120.25
    assert got["e2"].visit_end == dt.datetime(2020, 6, 30) and got["e2"].visting_total_fees is None


def test_clean_allergies(raw):
    got = {r.allergy_code: r for r in cl.clean_allergies(raw("allergies")).collect()}
    pen, grass = got[7980], got[300000000000]
    assert (pen.allergy_description, pen.allergen_nature) == ("Penicillin V", "drug")
    assert (grass.allergy_description, grass.allergen_nature) == ("Grass", "substance")
    assert (pen.primary_symptom_description, pen.primary_symptom_nature) == ("Eruption of skin", "disorder")
    assert (pen.secondary_symptom_code, pen.secondary_symptom_description, pen.secondary_symptom_severity) == (-1, "N/A", "N/A")
    assert (grass.primary_symptom_code, grass.secondary_symptom_description) == (-1, "Anaphylaxis")
    assert got[5].primary_symptom_nature == ""


def test_stray_header_row_costs_a_null_only(spark, tmp_path):
    folder = write_csv(tmp_path, header=True)
    got = cl.clean_allergies(files.read_entity(spark, f"{folder}/allergies.csv", "allergies", header=False))
    assert got.count() == 4 and got.where("allergy_code IS NULL").count() == 1


def test_quoted_values_keep_their_commas(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('2020-01-01,,u1,e1,S,1,"Fracture, closed ""left"" (disorder)"\n')
    assert one(cl.clean_conditions(files.read_entity(spark, str(path), "conditions")))["medical_concepts"] == 'Fracture, closed "left"'


def test_known_parents_and_orphans(spark):
    child = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "uuid string")
    parents = spark.createDataFrame([("a",), ("b",)], "uuid string")
    assert rows(cl.keep_known_parents(child, parents)) == [("a",), ("a",)]
    assert rows(cl.orphan_count(child, parents)) == [(2, 2)]
    assert qu.cascade_delete(child, spark.createDataFrame([("a",)], "uuid string")).count() == 2


def test_rules_report(spark, raw):
    people = cl.clean_patients(raw("patients"), LOADED_AT)
    report = {(r.rule, r.column): r.violations for r in qu.validate(people, "patients").collect()}
    assert report[("minimum", "family_income")] == 1 and report[("not_null", "birth_date")] == 1
    assert report[("unique", "uuid")] == 0 and report[("max_length", "gender")] == 0
    visits = cl.clean_encounters(raw("encounters"), AS_OF)
    tables = {"patients": people, "encounters": visits}
    report = {(r.rule, r.column): r.violations for r in qu.validate(cl.clean_allergies(raw("allergies")), "allergies", tables=tables).collect()}
    assert report[("allowed", "coding_system")] == 1 and report[("allowed", "primary_symptom_severity")] == 1
    assert report[("reference", "uuid")] == 0 and report[("reference", "encounter_id")] == 0
    report = {(r.rule, r.column): r.violations for r in qu.validate(visits, "encounters", tables=tables).collect()}
    assert report[("reference", "uuid")] == 1


def test_duplicates_ignore_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "uuid string, code int")
    assert rows(qu.duplicate_keys(df, ["uuid", "code"])) == [("a", 1, 2)]


def test_profiles(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), (None, None)], "x string, y int")
    assert sorted(rows(qu.null_profile(df))) == [("x", 1, 3), ("y", 2, 3)]
    assert sorted(rows(qu.value_profile(df, "x")), key=str) == [("a", 2), (None, 1)]
    assert [qu.rows_with_nulls(df, k).count() for k in (0, 1, 2)] == [1, 1, 1]


@pytest.fixture()
def table(spark, tmp_path):
    """The name of a table in a new database."""
    name = f"test_{uuid.uuid4().hex}"
    yield f"{store.create_database(spark, name, str(tmp_path / 'db'))}.t"
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_upsert_inserts_updates_and_replays(spark, table):
    make = lambda data: spark.createDataFrame(data, "k string, v string, at int")
    read = lambda: rows(store.read_store(spark, table).select("k", "v", "at"), "k")
    store.upsert(spark, table, make([("a", "1", 1), ("b", "1", 1), ("b", "2", 2)]), ["k"], "at")
    assert read() == [("a", "1", 1), ("b", "2", 2)]
    batch = make([("b", "3", 3), ("c", "1", 1)])
    for _ in range(2):
        store.upsert(spark, table, batch, ["k"], "at")
        assert read() == [("a", "1", 1), ("b", "3", 3), ("c", "1", 1)]
    store.upsert(spark, table, make([("c", "late", 0), ("a", "same", 1)]), ["k"], "at")
    assert read() == [("a", "same", 1), ("b", "3", 3), ("c", "1", 1)]  # equal order: the batch wins
    store.upsert(spark, table, make([("c", "none", None), ("d", "none", None)]), ["k"], "at")
    store.upsert(spark, table, make([("d", "again", None)]), ["k"], "at")
    assert read()[2:] == [("c", "1", 1), ("d", "again", None)]
    store.upsert(spark, table, make([]), ["k"], "at")
    assert len(read()) == 4


def test_upsert_of_keys_with_null_parts(spark, table):
    batch = spark.createDataFrame([("a", None, "x", 1), ("a", None, "y", 1), ("a", None, "x", 1), (None, 1, "x", 1), ("a", 1, "x", 1)], "k string, n int, v string, at int")
    for at in (1, 2):
        store.upsert(spark, table, batch.withColumn("at", F.lit(at)), ["k", "n"], "at")
    want = [("a", None, "x", 2), ("a", None, "y", 2), ("a", 1, "x", 2), (None, 1, "x", 2)]
    assert sorted(rows(store.read_store(spark, table)), key=str) == sorted(want, key=str)


def test_upsert_keeps_columns_that_a_batch_lacks(spark, table):
    store.upsert(spark, table, spark.createDataFrame([("a", 1), ("b", 1)], "k string, at int"), ["k"], "at")
    store.upsert(spark, table, spark.createDataFrame([("a", 1, "old"), ("b", 0, "old")], "k string, at int, extra string"), ["k"], "at")
    store.upsert(spark, table, spark.createDataFrame([("a", 2), ("c", 2)], "k string, at int"), ["k"], "at")
    assert rows(store.read_store(spark, table).select("k", "at", "extra"), "k") == [("a", 2, "old"), ("b", 1, "old"), ("c", 2, None)]
    store.upsert(spark, table, spark.createDataFrame([("a", 3, None)], "k string, at int, extra string"), ["k"], "at")
    assert rows(store.read_store(spark, table).select("k", "at", "extra"), "k")[0] == ("a", 3, None)


def test_upsert_refuses_other_keys_and_drops_old_versions(spark, table, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("at"))
    store.upsert(spark, table, df, ["k"], "at", buckets=3)
    with pytest.raises(ValueError):
        store.upsert(spark, table, df, ["at"], "k")
    for at in range(1, 5):
        store.upsert(spark, table, df.where(F.col("k") < "3").withColumn("at", F.lit(at)), ["k"], "at")
    got = store.read_store(spark, table)
    assert got.count() == 200 and got.where("at = 4").count() == df.where(F.col("k") < "3").count()
    assert store.describe(spark, table)["num_buckets"] == 3
    assert len([p for p in (tmp_path / "db").iterdir() if p.is_dir()]) == 2  # the newest version and the one before it


def test_upsert_that_stops_half_way_changes_nothing(spark, table, monkeypatch):
    df = spark.createDataFrame([("a", 1)], "k string, at int")
    store.upsert(spark, table, df, ["k"], "at")
    with monkeypatch.context() as m:
        whole = store.describe
        m.setattr(store, "describe", lambda spark, name: whole(spark, name) if name == table else (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.upsert(spark, table, df.withColumn("at", F.lit(2)), ["k"], "at")
    assert rows(store.read_store(spark, table)) == [("a", 1)]
    store.upsert(spark, table, df.withColumn("at", F.lit(3)), ["k"], "at")
    assert rows(store.read_store(spark, table)) == [("a", 3)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_are_not_shuffled(spark, table):
    """Neither to read the newest rows, nor to sum or join by key, nor to merge a batch."""
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("at"), "id")
    store.upsert(spark, table, df, ["k"], "at", buckets=5)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = store.read_store(spark, table)
        assert "Exchange" not in plan_of(stored) and "Exchange" not in plan_of(stored.groupBy("k").count())
        merged = store.merged(stored, df.repartition(5, "k"), ["k"], "at")
        join = plan_of(merged.where("k IS NOT NULL"))
        old = join[join.index("SortMergeJoin"):].split("_new_")[0]
        assert "Exchange" not in old and "Bucketed: true" in join
        assert "Exchange" in plan_of(store.read_keys(spark, table, "k").groupBy("k").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hot_key_in_a_batch(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    latest = store.latest_by_key(df, ["k"], "id")
    assert latest.count() == 2001 and one(latest.where("k = 'hot'"))["id"] == 2997


def test_metrics_store_replaces_one_key(spark, tmp_path):
    path = str(tmp_path / "m")
    df = lambda v: spark.createDataFrame([("x", v)], "name string, value bigint")
    store.write_metrics({"t": df(1)}, path, "patients", "Kpis", LOADED_AT)
    store.write_metrics({"t": df(2), "u": df(3)}, path, "patients", "Metrics", LOADED_AT)
    store.write_metrics({"t": df(9)}, path, "patients", "Kpis", LOADED_AT)
    store.write_metrics({"t": df(5)}, path, "encounters", "Kpis", LOADED_AT)
    got = {(r.metric_type, r.metric): json.loads(r.data) for r in store.read_metrics(spark, path, "patients").collect()}
    assert got == {("Kpis", "t"): {"name": "x", "value": 9}, ("Metrics", "t"): {"name": "x", "value": 2}, ("Metrics", "u"): {"name": "x", "value": 3}}
    board = rows(store.dashboard(spark, path, "patients").select("section", "metric"), "section", "metric")
    assert board == [("kpis", "t"), ("metrics", "t"), ("metrics", "u")]
    assert store.dashboard(spark, path, "nobody").count() == 0
    back = store.restore_metric(store.read_metrics(spark, path, "patients", "Kpis"), "t", "name string, value bigint")
    assert rows(back) == [("x", 9)]
    store.write_metrics({"t": df(1).limit(0)}, path, "patients", "Kpis", LOADED_AT)  # an empty result leaves no document
    assert store.read_metrics(spark, path, "patients", "Kpis").count() == 0
    assert qu.validate(store.read_metrics(spark, path), "metrics").where("violations > 0").count() == 0


@pytest.fixture()
def database(table):
    return table.partition(".")[0]


def test_load_and_analytics_runs(spark, tmp_path, database):
    csv, metrics = write_csv(tmp_path), str(tmp_path / "metrics")
    report = etl.run_load(spark, csv, database, AS_OF, LOADED_AT)
    # a patient without a birth date is refused, and with it the rows that refer to it; so is a negative income
    assert report.where("rule = 'rejected' AND column = 'not_null:birth_date' AND violations = 1").count() == 1
    assert report.where("rule = 'rejected' AND column = 'minimum:family_income' AND violations = 1").count() == 1
    assert report.where("rule = 'reference' AND column = 'uuid' AND violations = 2").count() == 2
    etl.run_load(spark, csv, database, AS_OF, LOADED_AT)  # replaying changes nothing
    t = etl.stored_tables(spark, database)
    assert (t.patients.count(), t.conditions.count(), t.encounters.count(), t.allergies.count()) == (1, 2, 1, 2)
    assert etl.rejects(spark, database, "patients").count() == 2
    analytics.run_analytics(t, metrics, AS_OF, LOADED_AT)
    keys = {tuple(r) for r in store.read_metrics(spark, metrics).select("entity_name", "metric_type").distinct().collect()}
    assert keys == {(e, m) for e in etl.LOADED for m in ("Kpis", "Metrics", "Advanced_metrics")}
    kpis = store.dashboard(spark, metrics, "encounters").where("section = 'kpis'").collect()
    current = next(json.loads(d.data) for d in kpis if '"current"' in d.data)
    assert current["total_visit_volume"] == 1


def test_load_refuses_what_breaks_the_contract(spark, tmp_path, database):
    csv = write_csv(tmp_path)
    with open(f"{csv}/allergies.csv", "a") as f:
        f.write("2020-01-01,,u1,nowhere,99,RxNorm,Dust,allergy,environment,,,,,,\n2020-01-01,,u1,e1,,RxNorm,Dust,allergy,environment,,,,,,\n")
        f.write("2020-01-01,,u1,e1,98,Other,Dust,allergy,environment,,,TERRIBLE,,,\n")
    with open(f"{csv}/patients.csv", "a") as f:
        f.write(",".join(patient_row("u4", social_security_number="1" * 17, gender="FF", family_income="-1")) + "\n")
    report = etl.run_load(spark, csv, database, AS_OF, LOADED_AT)
    refused = {tuple(r) for r in etl.rejects(spark, database, "allergies").select("rule", "allergy_code").collect()}
    assert {("reference:encounter_id", 99), ("not_null:allergy_code", None)} <= refused
    # every broken rule is listed
    assert {("allowed:coding_system", 98), ("allowed:primary_symptom_severity", 98)} <= refused
    assert {("reference:uuid", 5), ("reference:encounter_id", 5), ("allowed:coding_system", 5)} <= refused
    people = {tuple(r) for r in etl.rejects(spark, database, "patients").where("uuid = 'u4'").select("rule").collect()}
    assert people == {("minimum:family_income",), ("max_length:social_security_number",), ("max_length:gender",)}
    stored = etl.stored_tables(spark, database)
    assert stored.allergies.where("allergy_code IS NULL OR encounter_id = 'nowhere' OR allergy_code IN (5, 98)").count() == 0
    assert stored.patients.where("uuid = 'u4'").count() == 0
    assert report.where("entity = 'allergies' AND rule = 'reference' AND column = 'encounter_id'").first()["violations"] >= 1
    assert report.where("rule = 'rejected' AND column = 'reference:encounter_id'").first()["violations"] == 2
    assert report.where("entity = 'allergies' AND rule = 'allowed' AND column = 'coding_system'").first()["violations"] == 2
    assert etl.rejects(spark, database, "nobody") is None


def test_malformed_lines_are_refused(spark, tmp_path, database):
    csv = write_csv(tmp_path)
    with open(f"{csv}/conditions.csv", "a") as f:
        f.write("2020-01-01,,u1,e1,SNOMED,82272006,Cold, severe (disorder)\n2020-01-01,,u1\n")
    report = etl.run_load(spark, csv, database, AS_OF, LOADED_AT)
    assert report.where("entity = 'conditions' AND rule = 'malformed' AND column = 'line'").first()["violations"] == 2
    found = {r["line"] for r in etl.rejects(spark, database, "conditions").where("rule = 'malformed:line'").collect()}
    assert found == {"2020-01-01,,u1,e1,SNOMED,82272006,Cold, severe (disorder)", "2020-01-01,,u1"}
    assert etl.stored_tables(spark, database).conditions.where("medical_concepts = 'Cold'").count() == 0
    # a repeated load of a mended file replaces what that load refused
    write_csv(tmp_path)
    etl.run_load(spark, csv, database, AS_OF, LOADED_AT)
    assert etl.rejects(spark, database, "conditions").where("rule = 'malformed:line'").count() == 0


def test_one_join_for_each_reference(spark, raw):
    tables = {
        "patients": spark.createDataFrame([("u1",), ("u2",)], "uuid string"), "encounters": spark.createDataFrame([("e1",)], "encounter_id string"),
    }
    clean = cl.clean_allergies(raw("allergies"))
    marked = qu.with_broken_rules(clean, qu.RULES["allergies"], tables)
    plan = plan_of(marked)
    assert plan.count("Join ") == 2 and "Aggregate" not in plan
    got = {r.allergy_code: r.broken for r in marked.collect()}
    assert got == {7980: [], 300000000000: [], 5: ["allowed:coding_system", "allowed:primary_symptom_severity", "reference:encounter_id"]}
    names = qu.row_rules(clean, qu.RULES["allergies"], tables)
    counts = {(r.rule, r.column): r.violations for r in qu.broken_rule_counts(marked, "allergies", names).collect()}
    whole = {(r.rule, r.column): r.violations for r in qu.validate(clean, "allergies", tables=tables).where("rule != 'unique'").collect()}
    assert counts == whole


def test_missing_columns_get_their_defaults(spark):
    df = spark.createDataFrame([("a", None)], "uuid string, marital_status string")
    got = one(qu.add_missing_columns(df, qu.DEFAULTS["patients"]))
    assert got == {"uuid": "a", "marital_status": None, "doctorate": "No Doctorate", "family_income": 0}


def test_runs_want_utc(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        with pytest.raises(ValueError):
            etl.run_load(spark, str(tmp_path), str(tmp_path), AS_OF, LOADED_AT)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_medications_and_procedures(spark):
    med = [("2020-01-01T00:00:00Z", "", "u", "p", "e", "834061", "Penicillin", "10.5", "5.25", "2", "21", "195662009000", "Sore throat"),
           ("2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z", "u", "p", "e", "1", "x", "?", "", "", "", "none", "")]
    got = cl.clean_medications(spark.createDataFrame(med, raw_schema("medications"))).orderBy("rxnorm_medication_id").collect()
    assert [r.condition_id for r in got] == [None, 195662009000] and got[0].medication_cost is None
    proc = [("2020-01-01T20:00:00Z", "2020-01-01T21:00:00Z", "u", "e", "S", "428191000124101", "Review", "12.5", "10509002", "Bronchitis")]
    p = one(cl.clean_procedures(spark.createDataFrame(proc, raw_schema("procedures"))))
    assert p["procedure_start"] == dt.datetime(2020, 1, 2, 1, 30) and p["procedure_id"] == 428191000124101


def test_alternate_view_preview_and_parsing(spark, raw):
    alt = cl.alternate_allergies(cl.clean_allergies(raw("allergies")))
    assert alt.columns[:5] == ["recorded_date", "uuid", "encounter_id", "causative_agent_id", "code_system"]
    assert files.preview(alt, 2).count() == 2
    text = spark.createDataFrame([("2020-01-02", "2020-01-02 03:04:05"), ("bad", "bad")], "d string, t string")
    assert rows(files.parse_dates(text, ["d"], ["t"]))[0] == (date("2020-01-02"), dt.datetime(2020, 1, 2, 3, 4, 5))
    assert rows(files.parse_dates(text, ["d"], ["t"]))[1] == (None, None)
    end = spark.createDataFrame([(date("2020-01-02"),), (None,)], "e date").select(cl.fill_open_end(F.col("e")))
    assert rows(end) == [("2020-01-02",), ("Undergoing",)]


def test_membership_with_a_hot_key_keeps_every_row(spark):
    child = spark.range(3000).select(F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("uuid"), (F.col("id") % 7).alias("v"))
    keys = spark.createDataFrame([("hot",), ("3",), ("none",)], "uuid string")
    kept = cl.keep_known_parents(child, keys)
    assert kept.count() == 2001 and kept.columns == ["uuid", "v"]
    assert kept.agg(F.sum("v")).first()[0] == child.where("uuid IN ('hot', '3')").agg(F.sum("v")).first()[0]
    assert qu.cascade_delete(child, keys).count() == 999


def test_sketches_of_a_large_and_a_small_domain(spark):
    df = spark.range(200_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).alias("few"), F.when(F.col("id") < 0, 1).alias("none"))
    columns = ["key", "few", "none"]
    parts = qu.column_sketches(df.where("id < 120000"), columns).unionByName(qu.column_sketches(df.where("id >= 80000"), columns))  # they overlap
    got = {r.column: r for r in qu.sketched_profile(qu.merged_sketches(parts)).collect()}
    assert abs(got["key"].distinct - 200_000) < 200_000 * 0.05 and got["few"].distinct == 3 and got["none"].distinct == 0
    assert got["key"].rows == 240_000 and got["none"].nulls == 240_000
    assert qu.merged_sketches(qu.column_sketches(df.limit(0), columns)).count() == 3


def test_frequent_values_within_their_bound(spark):
    exact = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [(None,)] * 4 + [("c",)], "v string")
    assert sorted(rows(qu.frequent_values(exact, "v", 3)), key=str) == sorted([("a", 5), ("b", 3), (None, 4)], key=str)
    n, counters = 100_000, 512
    df = spark.range(n).select(F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") % 10 == 1, "warm").otherwise(F.col("id").cast("string")).alias("v"))
    got = dict(rows(qu.frequent_values(df, "v", 2, counters)))
    want = {"hot": n // 4, "warm": df.where("v = 'warm'").count()}
    assert set(got) == set(want) and all(abs(got[v] - want[v]) <= 4 * n / counters for v in want)


def test_means_do_not_depend_on_the_order_of_rows(spark):
    from careflow.operators import encounters as en

    values = [0.1, 1e9, -1e9, 0.2, 12345.678, 0.3] * 50
    schema = "encounter_type string, encounter_reason string, visiting_base_fees double, visting_total_fees double, coverage double"
    made = []
    for order in (values, values[::-1], sorted(values)):
        df = spark.createDataFrame([("t", "r", v, v, v / 3) for v in order], schema).repartition(3)
        made.append([rows(f(df)) for f in (en.coverage_vs_oop_by_type, en.fee_divergence_by_type, en.most_expensive_causes)])
    assert made[0] == made[1] == made[2]


def test_snapshots_follow_batches(spark, table, monkeypatch):
    from careflow.operators import encounters as en
    from careflow.plans import snapshots

    schema = "encounter_id string, visit_start timestamp, visit_end timestamp, uuid string, practioner_id string, visiting_base_fees double, visting_total_fees double, coverage double"
    t = lambda *d: dt.datetime(*d)
    first = [
        ("1", t(2020, 6, 30), t(2020, 6, 30, 2), "a", "p", 1.0, 2.5, None), ("2", t(2020, 6, 1, 3), None, "a", None, None, 7.25, 9.0),
        ("3", t(2019, 1, 1), t(2019, 1, 2), None, "p", 3.0, 4.0, 1.0), ("4", None, None, "b", "q", 3.0, None, None),
    ]
    second = [("5", t(2019, 5, 5), t(2019, 5, 6), "c", "q", 10.0, 11.0, 12.0), ("6", t(2020, 6, 29), t(2020, 6, 29, 1), "b", "p", 0.1, 0.2, 0.3)]
    one_df, two_df = (spark.createDataFrame(r, schema) for r in (first, second))
    assert snapshots.add_batch(spark, table, "one", snapshots.encounter_state(one_df), buckets=3)
    want = lambda *dfs: sorted(rows(en.encounter_kpis(spark.createDataFrame([r for d in dfs for r in d], schema), AS_OF)))
    assert sorted(rows(snapshots.encounter_snapshots(spark.table(table), AS_OF))) == want(first)
    # a batch that stops half-way changes nothing
    with monkeypatch.context() as m:
        m.setattr(store, "replace", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            snapshots.add_batch(spark, table, "two", snapshots.encounter_state(two_df))
    assert snapshots.add_batch(spark, table, "two", snapshots.encounter_state(two_df))
    assert not snapshots.add_batch(spark, table, "two", snapshots.encounter_state(two_df)) and not snapshots.add_batch(spark, table, "one", snapshots.encounter_state(one_df))
    assert sorted(rows(snapshots.encounter_snapshots(spark.table(table), AS_OF))) == want(first, second)
    assert snapshots.add_batch(spark, table, "none", snapshots.encounter_state(two_df.limit(0)))
    assert sorted(rows(snapshots.encounter_snapshots(spark.table(table), AS_OF))) == want(first, second)


def test_snapshots_read_their_state_without_shuffling_it(spark, table):
    from careflow.plans import snapshots

    state = spark.createDataFrame([("patient", "=a", AS_OF)], "kind string, key string, first_on date")
    state = state.withColumns({n: F.lit(None).cast("bigint") for n in snapshots.en.ADDENDS})
    store.replace(spark, table, state, snapshots.KEYS, 3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(snapshots.combined(spark.table(table), state.repartition(3, *snapshots.KEYS)))
        assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_snapshots_of_conditions_patients_and_allergies(spark, table):
    """NULLs in every column, a death on the reference day, a code that comes early in a later batch, a return across batches."""
    from careflow.operators import allergies as al, conditions as co, patients as pa
    from careflow.plans import snapshots

    d = date
    conditions = [
        ("a", "Cold", d("2020-06-01"), d("2020-06-11")), ("a", "Flu", d("2019-01-01"), None), ("b", "Cold", None, d("2020-01-01")), (None, "Cold", d("2020-06-29"), d("2020-06-30")),
        ("a", None, d("2018-01-01"), d("2018-02-01")), ("b", "Cold", d("2018-01-01"), d("2018-01-03")), ("a", "Cold", d("2017-01-01"), d("2017-05-01")), ("", "|", d("2020-01-01"), None),
    ]
    patients = [
        ("a", d("1990-01-01"), None, "F", "M", "PhD", 100), ("b", d("1980-05-05"), d("2020-06-23"), "M", "S", "No doctorate", 50), ("c", d("2020-06-25"), None, "F", None, None, None),
        ("e", d("1990-01-01"), None, "F", "M", "PhD", 100), ("f", None, d("2010-01-01"), None, "M", "PhD", 7), ("g", d("1950-01-01"), None, "M", "S", "No Doctorate", 300),
    ]
    allergies = [
        ("a", 1, d("2020-06-01"), None, "Penicillin", "medication", "drug", "MILD", "N/A", "Rash"), ("a", 2, d("2019-01-01"), d("2020-06-29"), "Dust", "environment", "substance", "SEVERE", "MILD", "Rash"),
        ("b", None, None, None, None, None, None, None, None, None), ("a", 1, d("2018-01-01"), None, "Penicillin", "medication", "drug", "SEVERE", "N/A", "Anaphylaxis"),
        ("c", 3, d("2020-06-20"), None, "penicillin", "food", "substance", "MILD", "N/A", "Rash"), (None, 3, d("2020-01-01"), None, "Nut", "food", "substance", "MILD", "N/A", "Rash"),
    ]
    visits = [("a", dt.datetime(2020, 5, 1, 4)), ("c", dt.datetime(2020, 6, 1)), ("c", dt.datetime(2020, 6, 21)), ("a", dt.datetime(2020, 5, 31, 4)), (None, dt.datetime(2020, 1, 1)), ("a", None)]
    make = {
        "c": lambda r: spark.createDataFrame(r, "uuid string, medical_concepts string, condition_record_date date, date_of_abetment date"),
        "p": lambda r: spark.createDataFrame(r, "uuid string, birth_date date, death_date date, gender string, marital_status string, doctorate string, family_income bigint"),
        "a": lambda r: spark.createDataFrame(r, (
            "uuid string, allergy_code bigint, allergy_detection_date date, allergy_cure_date date, allergy_description string, category string, allergen_nature string, "
            "primary_symptom_severity string, secondary_symptom_severity string, primary_symptom_description string")),
        "e": lambda r: spark.createDataFrame(r, "uuid string, visit_start timestamp"),
    }
    halves = lambda r: (r[::2], r[1::2])
    for n in (0, 1):
        snapshots.add_batch(spark, f"{table}_c", str(n), snapshots.condition_state(make["c"](halves(conditions)[n])), buckets=3)
        snapshots.add_batch(spark, f"{table}_p", str(n), snapshots.patient_state(make["p"](halves(patients)[n])), buckets=3)
        state = snapshots.allergy_state(*[make[k](halves(r)[n]) for k, r in (("a", allergies), ("p", patients), ("e", visits))])
        snapshots.add_batch(spark, f"{table}_a", str(n), state, buckets=3)
    whole = {"c": make["c"](conditions), "p": make["p"](patients), "a": make["a"](allergies), "e": make["e"](visits)}
    assert sorted(rows(snapshots.condition_snapshots(spark.table(f"{table}_c"), AS_OF))) == sorted(rows(co.condition_kpis(whole["c"], AS_OF)))
    for status in ("as_of", "recorded"):
        assert sorted(rows(snapshots.patient_snapshots(spark.table(f"{table}_p"), AS_OF, status))) == sorted(rows(pa.patient_kpis(whole["p"], AS_OF, status)))
    want = sorted(rows(al.allergy_kpis(whole["a"], whole["p"], whole["e"], AS_OF)))
    assert sorted(rows(snapshots.allergy_snapshots(spark.table(f"{table}_a"), AS_OF))) == want and len(want) == 4


def test_states_of_batches_made_in_one_pass(spark, table, monkeypatch):
    """The same rows as states made batch by batch; a batch named twice is added once, and the encounters are planned once."""
    from careflow.operators import encounters as en
    from careflow.plans import snapshots

    schema = (
        "batch string, visit_start timestamp, visit_end timestamp, uuid string, practioner_id string, encounter_type string, "
        "visiting_base_fees double, visting_total_fees double, coverage double"
    )
    day = dt.datetime(2020, 6, 1)
    df = spark.createDataFrame([
        ("x", day, day, "a", "p", "t", 1.0, 2.0, None), ("y", day, None, "a", None, None, 3.0, None, 1.0), ("x", None, day, None, "q", "t", None, 5.0, 1.0), ("y", day, day, "", "p", "u", 1.0, 1.0, 1.0),
    ], schema)
    calls = []
    monkeypatch.setattr(en, "started", lambda d, f=en.started: calls.append(1) or f(d))
    states = snapshots.encounter_state(df, by=["batch"])
    order = ["kind", "key", "first_on"]
    for name in ("x", "y"):
        own = snapshots.encounter_state(df.where(f"batch = '{name}'"))
        assert rows(states.where(f"batch = '{name}'").drop("batch"), *order) == rows(own, *order)
    del calls[:]
    snapshots.add_batches(spark, table, snapshots.encounter_state(df, by=["batch"]), ["x", "y", "y"])
    assert len(calls) == 1
    assert sorted(rows(snapshots.encounter_snapshots(spark.table(table), AS_OF))) == sorted(rows(en.encounter_kpis(df, AS_OF)))


def test_allergy_states_of_batches_made_in_one_pass(spark):
    from careflow.plans import snapshots

    d = date
    a = spark.createDataFrame([
        ("x", "a", 1, d("2020-06-01"), None, "Penicillin", "food", "drug", "MILD", "N/A", "Rash"), ("y", "a", 1, d("2019-06-01"), None, "Nut", None, None, None, None, None),
        ("y", None, 1, None, d("2020-01-01"), "Nut", None, None, None, None, None),
    ], "batch string, uuid string, allergy_code bigint, allergy_detection_date date, allergy_cure_date date, allergy_description string, category string, "
       "allergen_nature string, primary_symptom_severity string, secondary_symptom_severity string, primary_symptom_description string")
    p = spark.createDataFrame([("x", d("1990-01-01"), None), ("y", d("1990-01-01"), None), ("y", None, None)], "batch string, birth_date date, death_date date")
    e = spark.createDataFrame([("x", "a", dt.datetime(2020, 1, 1)), ("y", "a", dt.datetime(2020, 1, 1)), ("y", None, None)], "batch string, uuid string, visit_start timestamp")
    states = snapshots.allergy_state(a, p, e, by=["batch"])
    for name in ("x", "y"):
        own = snapshots.allergy_state(*[df.where(f"batch = '{name}'") for df in (a, p, e)])
        mine = states.where(f"batch = '{name}'").select(own.columns)
        assert rows(mine, *own.columns) == rows(own, *own.columns) and mine.count() > 2


def test_counted_values_are_those_of_the_operators(spark):
    from careflow.operators import encounters as en
    from careflow.plans import proxy

    e = proxy.encounters(spark, "/root/testdata/sf0.001")
    facts = en.facts_by_key(e, "CAST({} AS STRING)".format, counted=["encounter_type", "encounter_reason"])
    assert rows(en.counts_of_facts(facts, "encounter_type"), "encounter_type") == rows(en.encounters_by_type(e), "encounter_type")
    assert len(rows(en.counts_of_facts(facts, "encounter_reason"))) > 10
    assert rows(en.kpis_of_facts(facts, AS_OF), "period") == rows(en.encounter_kpis(e, AS_OF), "period")


def test_results_are_stored_from_one_pass_over_the_encounters(spark, monkeypatch):
    from careflow.queries import loading

    seen = []
    monkeypatch.setattr(loading.en, "started", lambda d, f=loading.en.started: seen.append(1) or f(d))
    monkeypatch.setattr(loading.en, "_typed", lambda *_: seen.append(1))
    assert len(rows(loading.s3_result_upsert(spark, "/root/testdata/sf0.001"))) == 4 and seen == [1]
