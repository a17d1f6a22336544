"""Generic statistics: ordered counts, median, Gini, Simpson, Shannon, life table, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from careflow.functions.columns import ratio, trunc
from careflow.functions.periods import aggregate_points

_BLOCK_BITS = 20  # a window never orders more than 2^20 siblings below the top level


def ordered_counts(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct integral values with their counts and running positions, without a global sort.

    Columns of other types are refused: their values would be cut to integers.
    ``weight`` names a column of row counts for input that is already aggregated.

    Returns ``by..., value, n, n_before, distinct_before, n_total``: the rows (and distinct
    values) that precede the value within its group. Rows are first reduced to one per distinct
    value with map-side combine, so a value or group holding a third of all rows costs nothing.
    The running sums are then built over blocks of 2^20 neighbouring values and blocks of blocks:
    every window partition holds at most 2^20 rows, and the top level one row per 2^40 values.
    """
    by = list(by)
    kind = df.schema[value].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{value} is {kind.simpleString()}; ranks are kept for integers only")
    v = F.col(value).cast("bigint")
    leaves = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, v.alias(value))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
        .withColumn("_mid", F.shiftright(value, _BLOCK_BITS))
        .withColumn("_top", F.shiftright(value, 2 * _BLOCK_BITS))
    )
    mids = leaves.groupBy(*by, "_top", "_mid").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    tops = mids.groupBy(*by, "_top").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))

    def before(part: list[str], order: str, what: Column) -> Column:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(w), F.lit(0))

    tops = tops.select(
        *by, "_top",
        before(by, "_top", F.col("n")).alias("_n0"),
        before(by, "_top", F.col("d")).alias("_d0"),
        F.sum("n").over(Window.partitionBy(*by)).alias("n_total"),
    )
    mids = mids.select(
        *by, "_top", "_mid",
        before([*by, "_top"], "_mid", F.col("n")).alias("_n1"),
        before([*by, "_top"], "_mid", F.col("d")).alias("_d1"),
    )
    leaves = leaves.select(
        *by, "_top", "_mid", value, "n",
        before([*by, "_top", "_mid"], value, F.col("n")).alias("_n2"),
        before([*by, "_top", "_mid"], value, F.lit(1)).alias("_d2"),
    )
    return (
        leaves.join(mids, [*by, "_top", "_mid"])
        .join(tops, [*by, "_top"])
        .select(
            *by, value, "n",
            (F.col("_n0") + F.col("_n1") + F.col("_n2")).alias("n_before"),
            (F.col("_d0") + F.col("_d1") + F.col("_d2")).alias("distinct_before"),
            "n_total",
        )
    )


def _values_at(df: DataFrame, value: str, by: Sequence[str], ranks: dict[str, Column], weight: str | None = None) -> DataFrame:
    """``by...`` and the values at 1-based ``ranks`` (name -> expression of ``n_total``) of an integral column per group.

    Rows are counted per distinct value with map-side combine; with ``weight`` each row is a distinct value with its count already. The counts
    of blocks of 2^20 neighbouring values tell the block that holds a rank, and only that block's values are put in order.
    One task orders the blocks of a group, 2^20 of them for values within 2^40 of each other.
    """
    by = list(by)
    kind = df.schema[value].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{value} is {kind.simpleString()}; ranks are kept for integers only")
    known = df.where(F.col(value).isNotNull())
    if weight is None:
        known = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    leaves = known.select(*by, F.col(value).cast("bigint").alias("_v"), F.col(weight or "_n").alias("_n")).withColumn(
        "_block", F.shiftright("_v", _BLOCK_BITS)
    )

    def before(part: list[str], order: str) -> Column:
        return F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = leaves.groupBy(*by, "_block").agg(F.sum("_n").alias("_n"))
    blocks = blocks.select("*", before(by, "_block").alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("n_total"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    hits = blocks.select(*by, "_block", "_n", "_before", F.explode(wanted).alias("_want")).where(
        "_before < _want.rank AND _want.rank <= _before + _n"
    )
    hits = hits.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_block"]], "_want.name", (F.col("_want.rank") - F.col("_before")).alias("_rank"))
    same = F.col("_block") == F.col("_of__block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = leaves.join(hits, same).withColumn("_before", before([*by, "name"], "_v"))
    found = inside.where("_before < _rank AND _rank <= _before + _n")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact median of an integral column per group (mean of the two middle values)."""
    n = F.col("n_total")
    middle = _values_at(df, value, by, {"_low": F.floor((n + 1) / 2), "_high": F.floor(n / 2) + 1})
    return middle.select(*by, ((F.col("_low") + F.col("_high")) / F.lit(2.0)).alias(name))


def lower_median(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, name: str = "median"
) -> DataFrame:
    """The lower of the two middle values per group, exact at any size."""
    return _values_at(df, value, by, {name: F.floor((F.col("n_total") + 1) / 2)}, weight)


def gini(df: DataFrame, value: str, rank_mode: str = "row", name: str = "gini") -> DataFrame:
    """Gini index 2*sum(x*rank)/(n*sum(x)) - (n+1)/n of an integral column, 3 decimals.

    ``row`` ranks rows 1..n (ties share no rank, which is the usual definition); ``dense`` gives
    tied rows one common rank, as the source reports do. 0.0 when the sum is not positive.
    """
    x, n, b = F.col(value).cast("double"), F.col("n").cast("double"), F.col("n_before").cast("double")
    if rank_mode == "row":
        rank_sum = n * b + n * (n + 1.0) / 2.0
    elif rank_mode == "dense":
        rank_sum = n * (F.col("distinct_before") + 1)
    else:
        raise ValueError(f"unknown rank_mode: {rank_mode}")
    total = ordered_counts(df, value).agg(
        F.sum(x * rank_sum).alias("xr"), F.sum(x * n).alias("sx"), F.sum("n").alias("n")
    )
    value_ = 2.0 * F.col("xr") / (F.col("sx") * F.col("n")) - (F.col("n") + 1.0) / F.col("n")
    return total.select(F.when(F.col("sx") > 0, F.round(value_, 3)).otherwise(F.lit(0.0)).alias(name))


def simpson_of_counts(n: Column) -> Column:
    """Aggregate: integer percentage 100 * (1 - sum(p^2)) of category counts ``n``."""
    share = F.try_divide(F.sum(n.cast("double") * n), F.sum(n).cast("double") * F.sum(n))
    return F.when(F.sum(n) > 0, trunc((F.lit(1.0) - share) * 100)).otherwise(F.lit(0).cast("bigint"))


def simpson_index(df: DataFrame, category: str, by: Sequence[str] = (), name: str = "simpson") -> DataFrame:
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(simpson_of_counts(F.col("_n")).alias(name))


def shannon_entropy(df: DataFrame, by: str, category: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy (bits, 3 decimals) of ``category`` within ``by``, with the counts.

    One row per (group, category) carrying the group's entropy; the window runs over the already
    aggregated counts, one row per category of a group.
    """
    counts = df.where(F.col(by).isNotNull()).groupBy(by, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    total = F.sum("n").over(w).cast("double")
    p = F.col("n") / F.col("total")
    return (
        counts.withColumn("total", total)
        .withColumn(name, F.round(F.abs(-F.sum(p * F.log2(p)).over(w)), 3))
        .drop("total")
    )


def dependency_ratio(
    df: DataFrame, age: Column, low: int = 20, high: int = 64, name: str = "dependency_ratio"
) -> DataFrame:
    """Integer percentage of people outside [low, high] per person inside; 0 without the latter."""
    inside = F.count_if(age.between(low, high))
    outside = F.count_if((age < low) | (age > high))
    return df.agg(trunc(ratio(outside, inside) * 100).alias(name))


def life_table(
    df: DataFrame, age: Column, died: Column, by: str, bins: Sequence[int], at_risk: str = "start"
) -> DataFrame:
    """Actuarial survival: running product of (1 - deaths / at risk) per age bin and group.

    The product is rounded to 3 decimals at every step. ``deaths`` fall in (top - width, top];
    ``at_risk='start'`` counts everyone older than the bin's lower end, ``'end'`` everyone who
    reached its top, as the source reports do. Rows are reduced to (group, age, died) counts
    first; the fold runs over the few bins of a group.
    """
    counts = df.groupBy(by, age.alias("_age"), died.alias("_died")).agg(F.count(F.lit(1)).alias("_n"))
    width = bins[0]

    def measures(top: int) -> dict[str, str]:
        exposed = f"_age > {top - width}" if at_risk == "start" else f"_age >= {top}"
        in_bin = f"_age > {top - width} AND _age <= {top} AND _died"
        return {
            "at_risk": f"coalesce(sum(IF({exposed}, _n, 0L)), 0L)",
            "deaths": f"coalesce(sum(IF({in_bin}, _n, 0L)), 0L)",
        }

    steps = aggregate_points(counts, [(str(t), measures(t)) for t in bins], "age", [by])
    seed = F.array().cast("array<struct<age:int,at_risk:bigint,deaths:bigint,survival:double>>")

    def step(acc: Column, s: Column) -> Column:
        before = F.coalesce(F.try_element_at(acc, F.lit(-1))["survival"], F.lit(1.0))
        rate = s["deaths"].cast("double") / F.greatest(s["at_risk"], F.lit(1)).cast("double")
        row = F.struct(
            s["age"].alias("age"), s["at_risk"].alias("at_risk"), s["deaths"].alias("deaths"),
            F.round(before * (F.lit(1.0) - rate), 3).alias("survival"),
        )
        return F.concat(acc, F.array(row))

    per_group = steps.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct("age", "at_risk", "deaths"))).alias("steps")
    )
    return per_group.select(by, F.inline(F.aggregate("steps", seed, step)))


COUNTED_BINS = "array<struct<bin:bigint,of:struct<n:bigint,events:bigint>>>"


def hazard_by_bins(
    df: DataFrame,
    value: str,
    event: Column,
    by: str,
    parts: int = 10,
    exclude: Sequence[str] = ("other",),
) -> DataFrame:
    """Event rate per group and equal-width value bin, every bin of every group present.

    Width = ceil((max - min) / parts), or 1000 when all values are equal; bin 0 is [0, width],
    bin i is [i * width + 1, (i + 1) * width], and bins below zero go on downwards. Only the bins from that of the least to that of the greatest
    value are given, about ``parts`` of them, however far from zero they lie. Rows without a value are a bin
    of their own, NULL, in the groups that have such rows. The extremes enter as scalar subqueries.
    """
    v = F.col(value)
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = F.coalesce(bounds["lo"], F.lit(0)), F.coalesce(bounds["hi"], F.lit(0))
    width = F.when(hi > lo, F.ceil((hi - lo) / F.lit(float(parts)))).otherwise(F.lit(1000)).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def bin_of(x: Column, size: Column) -> Column:
        return F.when(x == 0, zero).otherwise(F.floor((x - 1) / size)).cast("bigint")

    groups = df.where(F.col(by).isNotNull() & ~F.col(by).isin(*exclude))
    counts = (
        groups.select(by, value, event.alias("_event"), width.alias("width"))
        .groupBy(by, F.when(v.isNotNull(), bin_of(v, F.col("width"))).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_event").alias("events"))
    )
    # the histogram of a group is one map, spread over the bins there are; no join, and the counts are taken once
    entry = F.struct("n", "events")
    per_group = counts.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", entry.alias("of"))))).alias("_filled"),
        F.max(F.when(F.col("bin").isNull(), entry)).alias("_unknown"),
    ).withColumn("width", width)
    first = bin_of(lo, F.col("width"))
    per_group = per_group.withColumn("_bins", F.sequence(first, F.greatest(F.floor(hi / F.col("width")), first).cast("bigint")))
    known = F.transform("_bins", lambda i: F.struct(i.alias("bin"), F.try_element_at("_filled", i).alias("of")))
    unknown = F.when(F.col("_unknown").isNotNull(), F.array(F.struct(F.lit(None).cast("bigint").alias("bin"), F.col("_unknown").alias("of"))))
    rows = per_group.select(by, "width", F.inline(F.concat(known, F.coalesce(unknown, F.array().cast(COUNTED_BINS)))))
    n, events = F.coalesce("of.n", zero), F.coalesce("of.events", zero)
    return rows.select(
        by, "bin",
        F.when(F.col("bin").isNull(), "unknown").otherwise(F.concat(F.lit("Q"), F.col("bin").cast("string"))).alias("label"),
        F.when(F.col("bin") == 0, zero).otherwise(F.col("bin") * F.col("width") + 1).alias("low"),
        ((F.col("bin") + 1) * F.col("width")).alias("high"),
        n.alias("n"), events.alias("deaths"), F.round(ratio(events, F.greatest(n, F.lit(1))), 3).alias("hazard"),
    )


def zscore_outliers(df: DataFrame, by: str, value: str, k: float = 2.0) -> DataFrame:
    """Rows whose value exceeds mean + k * stddev of their group, counted per group.

    Equal values are combined map-side before the group statistics are joined back. A group that still holds a third of all rows is one
    large partition, which adaptive execution splits: the few outliers are dealt out anew before they are counted, so that
    nothing after the join needs its partitioning.
    """
    rows = df.select(by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    limits = (
        rows.groupBy(by)
        .agg(F.avg("_v").alias("_mean"), F.stddev_samp("_v").alias("_std"))
        .where(F.col("_std") > 0)
        .select(F.col(by).alias("_group"), (F.col("_mean") + F.lit(k) * F.col("_std")).alias("_limit"))
    )
    counted = rows.groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    outliers = counted.join(limits, (F.col(by) == F.col("_group")) & (F.col("_v") > F.col("_limit"))).select(by, "_n")
    return outliers.hint("rebalance").groupBy(by).agg(F.sum("_n").alias("anomaly_count"))


def top_k(df: DataFrame, by: str, k: int, name: str = "count") -> DataFrame:
    """The k most frequent values of a column, ties in the order of the value."""
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), by).limit(k)
