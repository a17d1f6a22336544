"""Keyed upsert of entity tables into bucketed catalog tables, and the metrics result store."""

from __future__ import annotations

import datetime as dt
import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

METRIC_KEY = ["entity_name", "metric_type"]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Where none is set, a local master gets a temporary folder; on a cluster that folder would be another one on each machine,
    so it is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="careflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- keyed tables


def _identity(df: DataFrame, keys: Sequence[str], order_col: str) -> Column:
    """NULL, but for a key with a NULL part all other columns: such rows are equal only as a whole."""
    partial = F.lit(False)
    for k in keys:
        partial = partial | F.col(k).isNull()
    rest = [c for c in df.columns if c not in keys and c != order_col and not c.startswith("_")]
    return F.when(partial, F.struct(*rest) if rest else F.lit(0))


def latest_by_key(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """The row with the greatest ``order_col`` of every key.

    Filtering ``row_number`` to 1 lets Spark cut every task's rows to one per key before the
    shuffle, so a key that holds a third of all rows is not shuffled row by row. Equal order
    values are decided by the remaining columns. Rows whose key has a NULL part are kept apart, but for rows that are equal in all
    columns other than ``order_col``.
    """
    rest = [c for c in df.columns if c not in keys and c != order_col]
    w = Window.partitionBy(*keys, "_same").orderBy(F.desc(order_col), *rest)
    named = df.withColumn("_same", _identity(df, keys, order_col))
    return named.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_same")


def create_database(spark: SparkSession, name: str, path: str) -> str:
    """A catalog database whose tables lie below ``path``; returns its name."""
    escaped = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{escaped}'")
    return name


def scratch_database(spark: SparkSession, name: str) -> str:
    """A new database below the shared folder."""
    return create_database(spark, f"{name}_{uuid.uuid4().hex}", scratch_path(spark, name))


def describe(spark: SparkSession, table: str) -> dict:
    """What the catalog has of a table: location, bucket columns and number, properties."""
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON").first()[0])


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _fields(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _version(location: str) -> int:
    return int(re.search(r"__v(\d+)_\w+/*$", location)[1])


def merged(stored: DataFrame, newest: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """``stored`` and ``newest``, each with one row per key, as one table with the newest row of each key; of equal ones that of ``newest``.

    A row keeps the values of columns that the other side lacks. Rows whose key has a NULL part are never joined, but kept once each.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    old = stored.where(whole).select(*[F.col(c).alias(f"_old_{c}") for c in stored.columns], F.lit(True).alias("_is_old"))
    new = newest.where(whole).select(*[F.col(c).alias(f"_new_{c}") for c in newest.columns], F.lit(True).alias("_is_new"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"_old_{k}") == F.col(f"_new_{k}"))
    is_newer = F.col("_is_old").isNull() | F.coalesce(F.col(f"_new_{order_col}") >= F.col(f"_old_{order_col}"), F.col(f"_old_{order_col}").isNull())
    takes_new = F.col("_is_new").isNotNull() & is_newer

    def value(c: str) -> Column:
        if c not in newest.columns:
            return F.col(f"_old_{c}").alias(c)
        if c not in stored.columns:
            return F.col(f"_new_{c}").alias(c)
        return F.when(takes_new, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)

    columns = list(dict.fromkeys([*stored.columns, *newest.columns]))
    rows = old.join(new, same, "full_outer").select(*map(value, columns))
    partial = stored.where(~whole).unionByName(newest.where(~whole), allowMissingColumns=True).select(*columns)
    return rows.unionByName(latest_by_key(partial, keys, order_col))


def upsert(spark: SparkSession, table: str, batch: DataFrame, keys: Sequence[str], order_col: str, buckets: int | None = None) -> None:
    """Add a batch to a keyed catalog table; of each key the row with the greatest ``order_col`` stays, of equal ones the batch's.

    ``table`` (``database.name``) is bucketed and sorted by its keys, in ``buckets`` (by default the number of shuffle
    partitions) when it is made. Only the batch is shuffled, to these buckets, and joined to the stored rows where
    they lie. The result is written as a bucketed table of its own and published by pointing ``table`` to it, so that a write that
    stops half-way changes nothing and can be repeated, as can a whole batch. The version before stays for those
    who read it until the next upsert. One writer at a time. Columns may come and go: an upserted row keeps the stored values of columns that its batch
    lacks. Keys and order column are kept with the table; other ones are refused.
    """
    newest = latest_by_key(batch, keys, order_col)
    if not spark.catalog.tableExists(table):
        replace(spark, table, newest, keys, buckets, {"order_by": order_col})
        return
    known = describe(spark, table)
    contract = sorted(known["bucket_columns"]), known["table_properties"]["order_by"]
    if contract != (sorted(keys), order_col):
        raise ValueError(f"{table} is keyed by {contract[0]} and ordered by {contract[1]}, not {list(keys)} and {order_col}")
    keys = known["bucket_columns"]
    rows = merged(spark.table(table), newest.repartition(known["num_buckets"], *keys), keys, order_col)
    replace(spark, table, rows, keys)


def replace(
    spark: SparkSession, table: str, rows: DataFrame, keys: Sequence[str], buckets: int | None = None, properties: dict[str, str] | None = None
) -> None:
    """Publish ``rows``, unique by ``keys``, as the next version of a bucketed table, or as its first; ``rows`` may be made of the version there is.

    A table that is there keeps its buckets and properties, and gains columns that it lacks.
    """
    database, _, name = table.rpartition(".")
    exists = spark.catalog.tableExists(table)
    if exists:
        known = describe(spark, table)
        n, version = known["num_buckets"], _version(known["location"])
    else:
        n, version = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        rows = rows.repartition(n, *keys)
    following = f"{table}__v{version + 1}_{uuid.uuid4().hex[:8]}"
    rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).saveAsTable(following)
    location = describe(spark, following)["location"].replace("'", "\\'")
    if exists:
        added = [f for f in rows.schema if f.name not in spark.table(table).columns]
        if added:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({_fields(T.StructType(added))})")
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
    else:
        given = ", ".join(f"'{k}' = '{v}'" for k, v in (properties or {}).items())
        spark.sql(
            f"CREATE TABLE {table} ({_fields(rows.schema)}) USING parquet CLUSTERED BY ({_names(keys)}) SORTED BY ({_names(keys)})"
            f" INTO {n} BUCKETS LOCATION '{location}'" + (f" TBLPROPERTIES ({given})" if given else "")
        )
    for old in spark.catalog.listTables(database or None, f"{name}__v*"):
        if _version(old.name) < version:
            spark.sql(f"DROP TABLE {database + '.' if database else ''}{old.name}")


def read_store(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of each key. Joins and sums by the table's keys need no shuffle of it."""
    return spark.table(table)


def read_keys(spark: SparkSession, table: str, *columns: str) -> DataFrame:
    """Columns of a table without its buckets: for joins with rows that may be skewed, which only a shuffle on both sides can split."""
    return spark.read.schema(spark.table(table).schema).parquet(describe(spark, table)["location"]).select(*columns)


# --- metrics store

DOCUMENT = "metric string, data string, updated_at timestamp, entity_name string, metric_type string"


def metric_rows(df: DataFrame, entity: str, metric_type: str, metric: str, updated_at: dt.datetime) -> DataFrame:
    """Result rows as documents: one JSON object per row of ``df``."""
    return df.select(
        F.lit(metric).alias("metric"),
        F.to_json(F.struct("*")).alias("data"),
        F.lit(updated_at).cast("timestamp").alias("updated_at"),
        F.lit(entity).alias("entity_name"),
        F.lit(metric_type).alias("metric_type"),
    )


def write_metrics(
    results: dict[str, DataFrame], store: str, entity: str, metric_type: str, updated_at: dt.datetime
) -> None:
    """S3: replace the documents of one (entity_name, metric_type), leaving all others alone.

    They are a partition of the store, which is overwritten as a whole once the new one is written. It always holds one marker row without a document, so that
    results without rows leave none of the old ones.
    """
    spark = next(iter(results.values())).sparkSession
    rows = spark.createDataFrame([(None, None, updated_at, entity, metric_type)], DOCUMENT)
    for name, df in results.items():
        rows = rows.unionByName(metric_rows(df, entity, metric_type, name, updated_at))
    writer = rows.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*METRIC_KEY).parquet(store)


def read_metrics(spark: SparkSession, store: str, entity: str | None = None, metric_type: str | None = None) -> DataFrame:
    """The documents of an entity and type, or of all; only their partitions are read. A store that is not there yet has none."""
    try:
        rows = spark.read.schema(DOCUMENT).parquet(store).where("metric IS NOT NULL")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DOCUMENT)
    for column, wanted in zip(METRIC_KEY, (entity, metric_type)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    return rows


def dashboard(spark: SparkSession, store: str, entity: str) -> DataFrame:
    """The documents of an entity by section (kpis, metrics, advanced_metrics) and result table.

    An entity without results gives no rows.
    """
    return read_metrics(spark, store, entity).select(
        "entity_name", F.lower("metric_type").alias("section"), "metric", "data", "updated_at"
    )


def restore_metric(rows: DataFrame, metric: str, schema: str) -> DataFrame:
    """One stored result table back as typed rows."""
    doc = F.from_json("data", schema)
    return rows.where(F.col("metric") == metric).select(doc.alias("d")).select("d.*")
