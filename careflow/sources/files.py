"""Reading entity files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.schemas import raw_schema


#: Column that holds the text of a malformed line.
LINE = "_line"


def read_lines(spark: SparkSession, path: str | list[str], entity: str, header: bool = False) -> DataFrame:
    """CSV file(s) of an entity with an explicit schema, and in ``_line`` the text of lines with more or fewer fields than it.

    Columns are read as text and typed in cleaning, so a stray header row or an unreadable value
    costs a NULL, not the job; no inference pass is run. ``header`` tells whether the files start
    with a header row. A malformed line (an unquoted comma, a line cut off) has its values in the wrong columns: ``well_formed`` and
    ``malformed`` tell them apart. Every field is parsed whatever columns are used later, so that the number of fields is known.
    """
    schema = raw_schema(entity)
    read = (
        spark.read.schema(raw_schema(entity).add(LINE, "string"))
        .options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE, columnPruning=False, enforceSchema=True, quote='"', escape='"')
        .csv(path)
    )
    # Spark refuses to read that column alone, so it takes no characters of another one along
    return read.withColumn(LINE, F.nullif(F.concat_ws("", LINE, F.substring(schema.names[0], 1, 0)), F.lit("")))


def well_formed(lines: DataFrame) -> DataFrame:
    """The rows of ``read_lines`` with as many fields as the entity has."""
    return lines.where(F.col(LINE).isNull()).drop(LINE)


def malformed(lines: DataFrame) -> DataFrame:
    """(line): the text of all other lines."""
    return lines.where(F.col(LINE).isNotNull()).select(F.col(LINE).alias("line"))


def read_entity(spark: SparkSession, path: str | list[str], entity: str, header: bool = False) -> DataFrame:
    """The well-formed lines of ``read_lines``."""
    return well_formed(read_lines(spark, path, entity, header))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A whole stored table, or a narrow projection that reaches the Parquet scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_database(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str
) -> DataFrame:
    """A database table read by key ranges in parallel (needs its JDBC driver on the class path)."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options
    )


def preview(df: DataFrame, n: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """N rows, the first by ``order`` where it is given; each task keeps no more than n."""
    return (df.orderBy(*order) if order else df).limit(n)


def parse_dates(df: DataFrame, dates: Sequence[str] = (), timestamps: Sequence[str] = ()) -> DataFrame:
    """Text columns back to dates and timestamps; unreadable text becomes NULL."""
    out = {c: F.try_to_date(F.col(c)) for c in dates} | {c: F.try_to_timestamp(F.col(c)) for c in timestamps}
    return df.withColumns(out)
