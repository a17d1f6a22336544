"""Chat logs: collapse cumulative snapshots of a conversation and render what remains. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import stored

#: Turns of a conversation that make one rendered row.
PART = 512
START, END = "<|im_start|>", "<|im_end|>"


def placed_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``place`` 1, 2, ... in the conversation and the rolling hash of the turns so far.

    Turns are ordered by turn, NULL first, and those of one turn number by a hash of role and text. The rolling hash ``h0`` .. ``h3`` of a prefix is four running sums of 32 bits each
    of the hashes of its turns with their places, so prefixes compare by a few numbers. The rows are dealt out by range and counted and summed
    within a range; what stands before in other ranges is added from one row for each range and conversation. So a
    conversation of any length is spread over tasks.
    """
    dealt = stored(
        turns.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("tie"))
        .repartitionByRange("conv_id", "turn", "tie").withColumn("_range", F.spark_partition_id()),
        "turns",
    )
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn", "tie", "role", "text")
    counted = dealt.groupBy("conv_id", "_range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("conv_id", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = _with(dealt.withColumn("place", F.row_number().over(inside)), before).withColumn("place", F.col("place") + F.col("before")).drop("before")
    digest = F.md5(F.concat_ws("|", F.col("place"), *(F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in ("role", "text"))))
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    hashed = stored(placed.select("*", *parts), "placed-turns")
    running = Window.partitionBy("conv_id", "_range").orderBy("place")
    sums = hashed.groupBy("conv_id", "_range").agg(*(F.sum(f"h{i}").alias(f"s{i}") for i in range(4)))
    offset = sums.select("conv_id", "_range", *(F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"before{i}") for i in range(4)))
    rolled = _with(hashed.select("*", *(F.sum(f"h{i}").over(running).alias(f"r{i}") for i in range(4))), offset)
    return rolled.select("conv_id", "role", "text", "place", *((F.col(f"r{i}") + F.col(f"before{i}")).alias(f"h{i}") for i in range(4)))


def _with(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` with the columns of their conversation's range, of which there is one row each."""
    of = of.withColumnRenamed("conv_id", "_conv").withColumnRenamed("_range", "_of")
    return rows.join(of, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_of"))).drop("_conv", "_of")


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations of ``placed`` that no longer one starts with.

    Of equal conversations the one with the smallest id stays, NULL last. Prefix hashes are cut to distinct ones before the
    anti-join, so a first turn that all conversations share is one row.
    """
    hashes = ["h0", "h1", "h2", "h3"]
    length = placed.groupBy("conv_id").agg(F.max("place").alias("n_turns")).withColumnRenamed("conv_id", "_conv")
    known = placed.drop("role", "text").join(length, F.col("conv_id").eqNullSafe(F.col("_conv")))
    whole = known.where("place = n_turns").groupBy("n_turns", *hashes).agg(F.min("conv_id").alias("conv_id"))
    proper = known.where("place < n_turns").select(F.col("place").alias("n_turns"), *hashes).distinct()
    return whole.join(proper, ["n_turns", *hashes], "left_anti").select("conv_id", "n_turns")


def _plain(text: Column) -> Column:
    """Text in which no marker can be read."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text): the turns of the ``kept`` conversations in chat markup.

    A conversation of up to ``PART`` turns is one row, part 0; a longer one goes on in further parts, whose texts join to the whole.
    A role of NULL is written as unknown, a text of NULL as an empty one; markers inside a text are broken up by a space.
    """
    turn = F.concat(
        F.lit(START), _plain(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), _plain(F.coalesce("text", F.lit(""))), F.lit(END + "\n")
    )
    kept = kept.withColumnRenamed("conv_id", "_conv")
    rows = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "n_turns", F.floor((F.col("place") - 1) / PART).cast("int").alias("part"), "place", turn.alias("line")
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return rows.groupBy("conv_id", "part", "n_turns").agg(F.array_join(lines, "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text) of the maximal conversations among logged snapshots ``turns`` (conv_id, turn, role, text).

    Rows without an id are one conversation. An empty table gives no rows.
    """
    placed = stored(placed_turns(turns), "rolled-turns")
    return render(placed, stored(maximal(placed), "maximal"))
