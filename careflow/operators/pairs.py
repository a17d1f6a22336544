"""Pair statistics within an owner (patient): co-occurrence, transitions, recurrence gaps.

Pair counts are defined over pairs of *items* (concepts), never over pairs of rows. Every operator
therefore reduces its input to one row per distinct item (and year) of an owner, with map-side
combine, before anything is joined. The join work of an owner depends on how many different items
it has, which the vocabulary bounds, and not on how many rows: an owner with a third of all rows
is an ordinary owner after the first aggregate. Pairs leave a task already summed by the partial
aggregate above the join, and the join is an equi-join that adaptive execution may split further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions.columns import ratio


def cooccurrence(df: DataFrame, owner: str, item: str, k: int, distinct: bool = True, name: str = "count") -> DataFrame:
    """The k item pairs (a < b) that share most owners.

    ``distinct=False`` counts pairs of rows instead: an owner with the rows of a and b in
    multiplicities m and n contributes m * n. The multiplicities are summed before the join, so
    repeated rows are never paired one by one.
    """
    counts = (
        df.where(F.col(owner).isNotNull() & F.col(item).isNotNull())
        .groupBy(owner, F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    )
    a = counts.selectExpr(owner, "item AS a_item", "n AS a_n")
    b = counts.selectExpr(owner, "item AS b_item", "n AS b_n")
    pairs = a.join(b, owner).where("a_item < b_item")
    weight = F.count(F.lit(1)) if distinct else F.sum(F.col("a_n") * F.col("b_n"))
    return (
        pairs.groupBy(F.col("a_item").alias("item_a"), F.col("b_item").alias("item_b"))
        .agg(weight.cast("bigint").alias(name))
        .orderBy(F.desc(name), "item_a", "item_b")
        .limit(k)
    )


def transition_counts(df: DataFrame, owner: str, item: str, date: str, horizon: int = 365) -> DataFrame:
    """Pairs of distinct (item, day) records of an owner with 0 < days from a to b <= horizon.

    Days are cut into buckets of ``horizon`` days. For a record of a in bucket i a partner lies
    either in bucket i at a later offset or in bucket i + 1 at an offset not above its own: two
    equi-joins on (owner, bucket), so a long history spreads over its buckets.

    The days of an item in a bucket are the bits of a few words. The a side has one row per
    distinct (item, day) with the mask of the offsets up to its own, the b side one row per item
    and bucket. The partners of a record among all days of an item are then one mask and one
    population count per word: the mask itself in the next bucket, its inverse in the own bucket.
    An owner with a third of all rows costs (items x days) x items, however many rows it has.
    """
    words = range(-(-horizon // _WORD_BITS))
    base = (
        df.where(F.col(owner).isNotNull() & F.col(item).isNotNull() & F.col(date).isNotNull())
        .select(owner, F.col(item).alias("item"), F.unix_date(F.col(date).cast("date")).alias("day"))
        .selectExpr(owner, "item", f"CAST(floor(day / {horizon}) AS INT) AS at", f"pmod(day, {horizon}) AS off")
        .groupBy(owner, "item", "at")
        .agg(*[F.expr(f"bit_or(IF({_in_word(w)}, shiftleft(1L, off % {_WORD_BITS}), 0L)) AS w{w}") for w in words])
    )
    pieces = ", ".join(f"named_struct('first', {_WORD_BITS * w}, 'word', w{w})" for w in words)
    # a word with one bit gives its position directly; only words with more are searched
    positions = (
        "IF(bit_count(word) = 1, array(bit_count(word - 1)), "
        f"filter(sequence(0, {_WORD_BITS - 1}), i -> (shiftright(word, i) & 1L) = 1L))"
    )
    a = (
        base.selectExpr(owner, "at", "item", f"inline(array({pieces}))")
        .where("word <> 0")
        .selectExpr(owner, "at", "item", "first", f"explode({positions}) AS i")
        .selectExpr(owner, "at", "item", "first + i AS off")
        .selectExpr(owner, "at", "item AS a_item", *[f"{_mask(w)} AS m{w}" for w in words])
    )
    bits = [f"w{w}" for w in words]
    places = "inline(array(named_struct('at', at, 'flip', -1L), named_struct('at', at - 1, 'flip', 0L)))"
    b = base.withColumnRenamed("item", "b_item").selectExpr(owner, "b_item", *bits, places)
    found = " + ".join(f"bit_count(w{w} & (m{w} ^ flip))" for w in words)
    return (
        a.join(b, [owner, "at"]).where("a_item <> b_item")
        .groupBy(F.col("a_item").alias("item_a"), F.col("b_item").alias("item_b"))
        .agg(F.expr(f"sum({found})").alias("transitions"))
        .where("transitions > 0")
    )


_WORD_BITS = 63  # bits used of a 64-bit word, so that words stay non-negative


def _in_word(w: int) -> str:
    return f"off BETWEEN {_WORD_BITS * w} AND {_WORD_BITS * w + _WORD_BITS - 1}"


def _mask(w: int) -> str:
    """Bits of word w for the offsets up to ``off``."""
    first = _WORD_BITS * w
    return (
        f"CASE WHEN off < {first} THEN 0L WHEN off >= {first + _WORD_BITS} THEN -1L "
        f"ELSE shiftrightunsigned(-1L, {first + 63} - off) END"
    )


def transitions(df: DataFrame, owner: str, item: str, date: str, k: int | None = 50, horizon: int = 365) -> DataFrame:
    """The k most frequent transitions a -> b (None: all) with their share of all transitions out of a."""
    out_of_a = Window.partitionBy("item_a")  # over the aggregated pairs
    rows = (
        transition_counts(df, owner, item, date, horizon)
        .withColumn("total_from_a", F.sum("transitions").over(out_of_a))
        .withColumn("probability", F.round(ratio(F.col("transitions"), F.col("total_from_a")), 2))
    )
    return rows if k is None else rows.orderBy(F.desc("transitions"), "item_a", "item_b").limit(k)


def recurrence_gaps(df: DataFrame, owner: str, item: str, start: str, end: str) -> DataFrame:
    """Average positive gap in days from the previous record's end to the next start, per item.

    Records of one owner and item are ordered by (start, end), open ends last. They are reduced to
    one row per start day first: within a day every record but the last is the predecessor of
    another record of that day, and only the last precedes the next day. The window then runs over
    distinct days, so an (owner, item) holding a third of all rows is at most a calendar long.
    """
    s, e = F.col(start), F.col(end)
    own_gap = F.datediff(s, e)  # positive only for records that end before they start
    early = e.isNotNull() & (own_gap > 0)
    per_day = (
        df.where(s.isNotNull())
        .groupBy(owner, item, s.alias("_day"))
        .agg(
            F.max(e).alias("_max_end"),
            F.bool_or(e.isNull()).alias("_open"),
            F.coalesce(F.sum(F.when(early, own_gap)), F.lit(0)).alias("_sum"),
            F.count_if(early).alias("_cnt"),
        )
        .withColumn("_last_end", F.when(~F.col("_open"), F.col("_max_end")))
    )
    last_gap = F.datediff("_day", "_last_end")
    last_early = F.coalesce(last_gap > 0, F.lit(False))
    prev_end = F.lag("_last_end").over(Window.partitionBy(owner, item).orderBy("_day"))
    gap = F.datediff("_day", prev_end)
    follows = F.coalesce(gap > 0, F.lit(False))
    zero = F.lit(0)
    return (
        per_day.select(
            item,
            (F.col("_sum") - F.when(last_early, last_gap).otherwise(zero) + F.when(follows, gap).otherwise(zero)).alias("_s"),
            (F.col("_cnt") - last_early.cast("int") + follows.cast("int")).alias("_c"),
        )
        .groupBy(item)
        .agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
        .where(F.col("_c") > 0)
        .select(item, (F.col("_s") / F.col("_c")).alias("avg_gap"))
    )


def first_return(days: Column, within: int = 30) -> Column:
    """Of an array of distinct days, the first that lies 1..within days after the one before it; NULL if none does."""
    start = F.struct(F.lit(None).cast("date").alias("before"), F.lit(None).cast("date").alias("found"))

    def step(acc: Column, d: Column) -> Column:
        returned = F.datediff(d, acc["before"]) <= within
        return F.struct(d.alias("before"), F.coalesce(acc["found"], F.when(returned, d)).alias("found"))

    return F.aggregate(F.array_sort(days), start, step)["found"]


def repeat_visit_days(df: DataFrame, owner: str, date: Column, within: int = 30) -> DataFrame:
    """First day on which an owner returned 1..within days after its previous visit day.

    Same-day repeats do not matter, so each task sends an owner's distinct days: at most a calendar of them.
    """
    days = df.select(owner, date.alias("_day")).groupBy(owner).agg(F.collect_set("_day").alias("_days"))
    return days.select(owner, first_return(F.col("_days"), within).alias("readmitted_on")).where("readmitted_on IS NOT NULL")
