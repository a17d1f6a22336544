from __future__ import annotations

import math
import random
import statistics as pystat

import pytest
from pyspark.sql import functions as F

from careflow.operators import statistics as st
from conftest import one, rows

WIDE = [0, 5, 5, -3, 1 << 19, (1 << 20) + 1, (1 << 20) + 1, 1 << 41, (1 << 41) + 7, -(1 << 45), 5]


def test_ordered_counts_across_blocks(spark):
    df = spark.createDataFrame([(v,) for v in WIDE] + [(None,)], "v bigint")
    got = rows(st.ordered_counts(df, "v"), "v")
    want = [
        (v, WIDE.count(v), sum(x < v for x in WIDE), len({x for x in WIDE if x < v}), len(WIDE))
        for v in sorted(set(WIDE))
    ]
    assert got == want


def test_exact_median_per_group(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.5 else rnd.choice("abc"), rnd.choice([7, rnd.randint(-50, 1 << 42)])) for _ in range(301)]
    df = spark.createDataFrame(data, "g string, v bigint")
    got = dict(rows(st.exact_median(df, "v", ["g"])))
    for g in {g for g, _ in data}:
        assert got[g] == pystat.median([v for h, v in data if h == g])


def gini_of(values, ranks):
    n, s = len(values), sum(values)
    return round(2 * sum(v * r for v, r in zip(values, ranks)) / (s * n) - (n + 1) / n, 3)


def test_gini_with_ties(spark):
    values = sorted([10, 10, 20, 40, 40, 40, 90])
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    dense = {v: i + 1 for i, v in enumerate(sorted(set(values)))}
    assert one(st.gini(df, "v"))["gini"] == gini_of(values, range(1, 8))
    assert one(st.gini(df, "v", "dense"))["gini"] == gini_of(values, [dense[v] for v in values])


def test_gini_extremes(spark):
    equal = spark.createDataFrame([(5,)] * 4, "v bigint")
    nothing = spark.createDataFrame([(0,)] * 4, "v bigint")
    assert one(st.gini(equal, "v"))["gini"] == 0.0
    assert one(st.gini(nothing, "v"))["gini"] == 0.0
    with pytest.raises(ValueError):
        st.gini(equal, "v", "other")


def test_simpson_and_entropy(spark):
    data = [("x", "a")] * 2 + [("x", "b")] * 2 + [("y", "a")] * 3 + [(None, "a")]
    df = spark.createDataFrame(data, "city string, race string")
    assert one(st.simpson_index(df, "race"))["simpson"] == int((1 - (6 / 8) ** 2 - (2 / 8) ** 2) * 100)
    assert rows(st.shannon_entropy(df, "city", "race"), "city", "race") == [
        ("x", "a", 2, 1.0), ("x", "b", 2, 1.0), ("y", "a", 3, 0.0),
    ]


def test_simpson_of_nobody(spark):
    assert one(st.simpson_index(spark.createDataFrame([], "race string"), "race"))["simpson"] == 0


def test_dependency_ratio_bounds(spark):
    df = spark.createDataFrame([(a,) for a in (19, 20, 64, 65, 0)], "age int")
    assert one(st.dependency_ratio(df, F.col("age")))["dependency_ratio"] == 150
    only_old = spark.createDataFrame([(70,)], "age int")
    assert one(st.dependency_ratio(only_old, F.col("age")))["dependency_ratio"] == 0


@pytest.mark.parametrize("mode", ["start", "end"])
def test_life_table(spark, mode):
    data = [("M", 3, True), ("M", 5, False), ("M", 6, True), ("M", 12, False), ("F", 10, True), ("F", 11, False)]
    df = spark.createDataFrame(data, "gender string, age int, died boolean")
    got = rows(st.life_table(df, F.col("age"), F.col("died"), "gender", [5, 10, 15], mode), "gender", "age")
    want = []
    for g in ("F", "M"):
        s = 1.0
        for top in (5, 10, 15):
            ages = [a for x, a, _ in data if x == g]
            exposed = sum(a > top - 5 for a in ages) if mode == "start" else sum(a >= top for a in ages)
            deaths = sum(x == g and top - 5 < a <= top and d for x, a, d in data)
            s = round(s * (1 - deaths / max(exposed, 1)), 3)
            want.append((g, top, exposed, deaths, s))
    assert got == want


def test_survival_never_rises(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([("M", rnd.randint(0, 90), rnd.random() < 0.5) for _ in range(200)], "gender string, age int, died boolean")
    s = [r.survival for r in st.life_table(df, F.col("age"), F.col("died"), "gender", list(range(5, 90, 5))).orderBy("age").collect()]
    assert s == sorted(s, reverse=True) and len(s) == 17


def test_hazard_bins(spark):
    data = [("r", 0, True), ("r", 1, False), ("r", 10, True), ("r", 11, False), ("r", 100, True), ("q", None, True), ("other", 50, True)]
    df = spark.createDataFrame(data, "race string, v bigint, died boolean")
    got = st.hazard_by_bins(df, "v", F.col("died"), "race").where("race = 'r'").orderBy("bin").collect()
    assert [(r.label, r.low, r.high) for r in got[:2]] == [("Q0", 0, 10), ("Q1", 11, 20)]
    assert len(got) == 11  # bins start at 0, 10, ... 100; the maximum falls into Q9
    assert [(r.n, r.deaths, r.hazard) for r in got] == [(3, 2, 0.667), (1, 0, 0.0)] + [(0, 0, 0.0)] * 7 + [(1, 1, 1.0), (0, 0, 0.0)]
    assert {r.race for r in st.hazard_by_bins(df, "v", F.col("died"), "race").collect()} == {"r", "q"}


def test_outliers_in_a_hot_group(spark):
    rnd = random.Random(4)
    data = [("hot", 10.0)] * 300 + [("hot", 500.0)] * 4 + [("flat", 3.0)] * 5 + [("one", 1.0)]
    data += [("b", rnd.gauss(10, 1)) for _ in range(80)] + [("b", 99.0)] + [(None, 1e9), ("b", None)]
    df = spark.createDataFrame(data, "g string, v double")
    want = {}
    for g in ("hot", "flat", "one", "b"):
        v = [x for h, x in data if h == g and x is not None]
        sd = pystat.stdev(v) if len(v) > 1 else 0.0
        n = sum(x > pystat.fmean(v) + 2 * sd for x in v) if sd > 0 else 0
        if n:
            want[g] = n
    assert dict(rows(st.zscore_outliers(df, "g", "v"))) == want


def test_top_k_ties(spark):
    df = spark.createDataFrame([(x,) for x in "bbaaccd"] + [(None,)] * 9, "x string")
    assert rows(st.top_k(df, "x", 2)) == [("a", 2), ("b", 2)]
    assert math.isclose(st.top_k(df, "x", 9).count(), 4)


def test_lower_median_of_weighted_counts(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 9, 2), ("b", 5, 1), ("b", 1 << 45, 2)], "g string, v bigint, w bigint")
    assert dict(rows(st.lower_median(df, "v", ["g"], "w"))) == {"a": 1, "b": 1 << 45}
