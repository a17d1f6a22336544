from __future__ import annotations

from pyspark.sql import functions as F

from careflow.operators import quality as qu
from careflow.operators.quality import Rules
from careflow.plans.proxy import conditions, source, with_views
from careflow.queries.registry import query


@query("d1_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def d1_duplicate_keys(spark, sf_dir):
    return qu.duplicate_keys(source(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("d2_missing_references", """
SELECT o_custkey, count(*) AS rows FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""")
def d2_missing_references(spark, sf_dir):
    solvent = source(spark, sf_dir, "customer").where("c_acctbal > 0")
    return qu.missing_references(source(spark, sf_dir, "orders"), "o_custkey", solvent, "c_custkey")


ORDER_RULES = Rules(
    unique=[["o_orderkey"]],
    not_null=["o_orderkey", "o_custkey"],
    references={"o_custkey": ("customer", "c_custkey")},
    minimum={"o_totalprice": 1000},
    allowed={"o_orderstatus": ["O", "F"]},
    max_length={"o_orderpriority": 8},
)


@query("d3_quality_report", """
SELECT 'orders' AS entity, rule, "column", violations FROM (
  SELECT 'not_null' AS rule, 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS violations FROM orders
  UNION ALL SELECT 'not_null', 'o_custkey', count(*) FILTER (o_custkey IS NULL) FROM orders
  UNION ALL SELECT 'minimum', 'o_totalprice', count(*) FILTER (o_totalprice < 1000) FROM orders
  UNION ALL SELECT 'allowed', 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders
  UNION ALL SELECT 'max_length', 'o_orderpriority', count(*) FILTER (length(o_orderpriority) > 8) FROM orders
  UNION ALL SELECT 'unique', 'o_orderkey', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'reference', 'o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def d3_quality_report(spark, sf_dir):
    return qu.validate(
        source(spark, sf_dir, "orders"), "orders", ORDER_RULES, {"customer": source(spark, sf_dir, "customer")}
    )


@query("d_rejects", """
SELECT o_orderkey, unnest(list_filter([
         CASE WHEN o_totalprice < 1000 THEN 'minimum:o_totalprice' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'allowed:o_orderstatus' END,
         CASE WHEN length(o_orderpriority) > 8 THEN 'max_length:o_orderpriority' END,
         CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'reference:o_custkey' END], lambda x: x IS NOT NULL)) AS rule
FROM orders""")
def d_rejects(spark, sf_dir):
    """All rules that each order breaks, as the load refuses rows."""
    solvent = source(spark, sf_dir, "customer").where("c_acctbal > 0")
    marked = qu.with_broken_rules(source(spark, sf_dir, "orders"), ORDER_RULES, {"customer": solvent})
    return marked.select("o_orderkey", F.explode("broken").alias("rule"))


@query("d_rejects_report", """
SELECT 'orders' AS entity, rule, "column", violations FROM (
  SELECT 'not_null' AS rule, 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS violations FROM orders
  UNION ALL SELECT 'not_null', 'o_custkey', count(*) FILTER (o_custkey IS NULL) FROM orders
  UNION ALL SELECT 'minimum', 'o_totalprice', count(*) FILTER (o_totalprice < 1000) FROM orders
  UNION ALL SELECT 'allowed', 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders
  UNION ALL SELECT 'max_length', 'o_orderpriority', count(*) FILTER (length(o_orderpriority) > 8) FROM orders
  UNION ALL SELECT 'reference', 'o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))""")
def d_rejects_report(spark, sf_dir):
    tables = {"customer": source(spark, sf_dir, "customer").where("c_acctbal > 0")}
    orders = source(spark, sf_dir, "orders")
    marked = qu.with_broken_rules(orders, ORDER_RULES, tables)
    return qu.broken_rule_counts(marked, "orders", qu.row_rules(orders, ORDER_RULES, tables))


@query("d4_range_check", "SELECT count(*) FILTER (c_acctbal < 0) AS violations, 'minimum' AS rule, 'c_acctbal' AS \"column\" FROM customer")
def d4_range_check(spark, sf_dir):
    return qu.row_violations(source(spark, sf_dir, "customer"), Rules(minimum={"c_acctbal": 0}))


@query("d5_enum_check", "SELECT count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS violations, 'allowed' AS rule, 'o_orderpriority' AS \"column\" FROM orders")
def d5_enum_check(spark, sf_dir):
    return qu.row_violations(source(spark, sf_dir, "orders"), Rules(allowed={"o_orderpriority": ["1-URGENT", "2-HIGH"]}))


@query("d6_length_limit", "SELECT count(*) FILTER (length(p_name) > 10) AS violations, 'max_length' AS rule, 'p_name' AS \"column\" FROM part")
def d6_length_limit(spark, sf_dir):
    return qu.row_violations(source(spark, sf_dir, "part"), Rules(max_length={"p_name": 10}))


@query("d7_column_defaults", with_views(["conditions"], """
SELECT coalesce(date_of_abetment, DATE '9999-12-31') AS date_of_abetment, count(*) AS count FROM conditions GROUP BY 1"""))
def d7_column_defaults(spark, sf_dir):
    text = conditions(spark, sf_dir).select(F.col("date_of_abetment").cast("string").alias("date_of_abetment"))
    filled = qu.apply_defaults(text, {"date_of_abetment": "9999-12-31"})
    return filled.groupBy(F.to_date("date_of_abetment").alias("date_of_abetment")).agg(F.count(F.lit(1)).alias("count"))


@query("d8_cascade_delete", """
SELECT o_orderstatus, count(*) AS count, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_orderstatus""")
def d8_cascade_delete(spark, sf_dir):
    removed = source(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    kept = qu.cascade_delete(source(spark, sf_dir, "orders"), removed, "o_custkey")
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_PROFILED = ["condition_record_date", "date_of_abetment", "uuid", "medical_concepts"]


@query("d9_null_profile", with_views(["conditions"], " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS rows FROM conditions" for c in _PROFILED
)))
def d9_null_profile(spark, sf_dir):
    return qu.null_profile(conditions(spark, sf_dir), _PROFILED)


@query("d9_value_profile", "SELECT l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 1")
def d9_value_profile(spark, sf_dir):
    return qu.value_profile(source(spark, sf_dir, "lineitem"), "l_returnflag")


@query("d9_sketched_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_linenumber")
))
def d9_sketched_profile(spark, sf_dir):
    """Sketches of the lines of each year of shipment, merged."""
    columns = ["l_returnflag", "l_linestatus", "l_linenumber"]
    lines = source(spark, sf_dir, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    parts = [qu.column_sketches(lines.where(part), columns) for part in (late, ~late, late.isNull())]
    return qu.sketched_profile(qu.merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2])))


@query("d9_frequent_values", "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def d9_frequent_values(spark, sf_dir):
    return qu.frequent_values(source(spark, sf_dir, "orders"), "o_orderpriority", 10)


@query("d10_complete_records", with_views(["conditions"], """
SELECT medical_concepts, count(*) AS count FROM conditions WHERE date_of_abetment IS NOT NULL GROUP BY medical_concepts"""))
def d10_complete_records(spark, sf_dir):
    complete = qu.rows_with_nulls(conditions(spark, sf_dir), 0)
    return complete.groupBy("medical_concepts").agg(F.count(F.lit(1)).alias("count"))
