"""Mixing sources to target weights by repeating and dropping documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import stored, unused, word_count

#: Hexadecimal digits of a document's hash that make its random number, exact as a double.
DIGITS = 13


def numbered(keys: DataFrame, col: str) -> DataFrame:
    """``keys`` with ``place`` 0, 1, ... in the order of ``col``, NULL last.

    The rows are dealt out by range and counted within a range; only the number of rows of each range meets in one task.
    """
    dealt = stored(
        keys.repartitionByRange(F.asc_nulls_last(col)).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last(col)))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.withColumn("_inside", inside).join(ranges, "_range").withColumn(
        "place", F.col("_before") + F.col("_inside") - 1
    ).drop("_range", "_rows", "_before", "_inside")


def source_targets(
    sized: DataFrame, source_col: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target, rate) of each source of ``sized`` (source, size).

    Sources in code point order, NULL last, take the ``weights`` in turn and share ``share`` times all sizes by weight. A target stops
    at ``most`` times its source's size, and what is left over goes to the others by weight, until none is above. The level
    of words per weight that does this is found in rounds of one sum over the sources each.
    A source without words has target and rate 0.
    """
    spark = sized.sparkSession
    # summed once per source and task before the shuffle, however many rows one source has
    sources = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = stored(
        numbered(sources, "source").select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * most).alias("cap")),
        "sources",
    )
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, free = 0.0, None
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        used, rest, n = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count_if(~full)
        ).first()
        if n == free or not rest:
            break
        level, free = (total - used) / rest, n
    target = F.least("cap", F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sources.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def copies(rate: Column, doc_id: Column, seed: str = "mix") -> Column:
    """floor(rate) copies, and one more with the probability of the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("int")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it (see ``plan_mix``).

    NULL and empty texts have size 0 and are taken like others of their source; a NULL source is a source. Rows of equal id are all taken
    equally often, those without an id too. An empty table gives an empty one.
    """
    targets = source_targets(docs.select(source_col, word_count(F.col(text_col)).alias("size")), source_col, weights, share, most)
    of, rate, copy = unused(docs, "_source", "_rate", "_copy")
    rates = targets.select(F.col("source").alias(of), F.col("rate").alias(rate))
    taken = docs.join(rates, F.col(of).eqNullSafe(F.col(source_col)), "left")
    # at most ``most`` copies of a row are made, so the rows made are bounded by the rows read
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies(F.col(rate), F.col(id_col), seed)))).drop(copy, rate, of)


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of each row of ``docs``.

    Size is a text's number of words (NULL, empty and blank texts: 0). A source's rate is its target over its size, never above
    ``most``; a document is taken floor(rate) times and once more if the random number of its id is below the fraction, so reruns and
    repeated rows agree and no document is taken more than ``most`` times its size. Ids of NULL share one number.
    """
    sized = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes"
    )
    targets = source_targets(sized, "source", weights, share, most)
    rates = targets.withColumnRenamed("source", "_source")
    planned = sized.join(rates, F.col("_source").eqNullSafe(F.col("source")), "left").drop("_source")
    return planned.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed)).withColumn(
        "taken", F.col("copies") * F.col("size")
    )
