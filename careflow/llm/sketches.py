"""Document fingerprints: bottom-k sketches of word shingles. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import SPACES, stored, unused

K, WIDTH = 128, 5


def with_sketch(df: DataFrame, text_col: str, sketch_col: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with ``sketch_col``: the ``k`` smallest distinct hashes, ascending, of the text's shingles of ``width`` words.

    Words are ``[^\\x20\\x09-\\x0D]+`` as written. A text of fewer words is one shingle; NULL, empty and blank texts have an empty sketch.
    Words are hashed once and a shingle's hash is made of its words' hashes.
    """
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACES, " " * len(SPACES))
    (at_words,) = unused(df, "_words")
    hashed = df.withColumn(at_words, F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.size(at_words)

    def shingle(at: Column) -> Column:
        return F.xxhash64(*[F.get(at_words, at + j) for j in range(width)])

    shingles = (
        F.when(n >= width, F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), shingle))
        .when(n > 0, F.array(F.xxhash64(at_words)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return hashed.withColumn(sketch_col, smallest(shingles, k)).drop(at_words)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets of shingles, from their sketches."""
    return smallest(F.concat(a, b), k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1, of two sets of shingles: the share of their union's sketch that is in both. Two empty ones are alike."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that are in ``b``; an empty set is contained in every set."""
    union = distinct_shingles(merge(a, b, k), k)
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / own))


def merge_rows(parts: DataFrame, keys: Sequence[str], sketch_col: str, k: int = K) -> DataFrame:
    """(keys, sketch) of documents whose parts have one sketch each; each task cuts a key's hashes to ``k`` before the shuffle."""
    order = Window.partitionBy(*keys).orderBy("_hash")
    ranked = parts.select(*keys, F.explode(sketch_col).alias("_hash")).distinct().withColumn("_rank", F.row_number().over(order))
    kept = ranked.where(F.col("_rank") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list("_hash")).alias(sketch_col))
    return parts.select(*keys).distinct().join(kept, list(keys), "left").withColumn(
        sketch_col, F.coalesce(sketch_col, F.array().cast("array<bigint>"))
    )


def fingerprint_text(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _range_of(place: Column, borders: list) -> Column:
    """Number of ``borders`` (ascending) below ``place``, counted in two steps of about the root of their number each."""
    if not borders:
        return F.lit(0)
    step = max(1, int(len(borders) ** 0.5))
    coarse = F.array_size(F.filter(F.lit(borders[step - 1::step]), lambda b: b < place))
    fine = F.array_size(F.filter(F.slice(F.lit(borders), coarse * step + 1, step), lambda b: b < place))
    return F.when(place.isNull(), -1).otherwise(coarse * step + fine)


def with_next(docs: DataFrame, id_col: str, text_col: str, sketch_col: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): each row with the next one by descending id, the last one with the first.

    Rows of equal id are ordered by a hash of their texts, ids of NULL come last. Ids are cut to ranges at their approximate
    quantiles, as many as there are shuffle partitions; a text is shuffled once, to its range, sorted and read beside the next one there.
    Only the first row of each range is looked up for the last one of the range before.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    borders = sorted(set(cuts))
    placed = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("tie"),
        _range_of(F.col(id_col).cast("long"), borders).alias("range"),
    )
    # one row for each range, whose number is that of the shuffle partitions
    heads = placed.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("head")).select("range", "head.*").orderBy(F.desc("range")).collect()
    after = {r["range"]: heads[(n + 1) % len(heads)] for n, r in enumerate(heads)}
    table = spark.createDataFrame(
        [(r, h["range"], h["id"], h["tie"]) for r, h in after.items()], f"last_of int, head_range int, head_id {dict(docs.dtypes)[id_col]}, head_tie long"
    )
    first = with_sketch(
        placed.join(
            F.broadcast(table), (F.col("range") == F.col("head_range")) & F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
        ).select("last_of", "text").dropDuplicates(["last_of"]),
        "text", "sketch", k, width,
    )
    first = stored(first.select("last_of", F.col("text").alias("first_text"), F.col("sketch").alias("first_sketch")), "first-of-ranges")
    sketched = with_sketch(placed.repartition("range"), "text", "sketch", k, width)
    order = Window.partitionBy("range").orderBy(F.desc_nulls_last("id"), F.desc("tie"))
    beside = sketched.select("*", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
    joined = beside.join(F.broadcast(first), F.col("range") == F.col("last_of"), "left")
    return joined.select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("sketch").alias(sketch_col),
        F.coalesce("next_text", "first_text").alias("next_text"), F.coalesce("next_sketch", "first_sketch").alias("next_sketch"),
    )
