"""Pair operators against brute force, including an owner that holds most rows."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from careflow.operators import pairs
from conftest import date, rows

SCHEMA = "uuid string, concept string, start date, end date"


def random_records(seed: int, n: int = 600):
    """Two thirds of the rows belong to one owner, half of those to one concept."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        owner = "hot" if rnd.random() < 0.66 else f"p{rnd.randint(0, 15)}"
        concept = "A" if owner == "hot" and rnd.random() < 0.5 else rnd.choice("ABCDEFG")
        start = dt.date(1968, 1, 1) + dt.timedelta(days=rnd.randint(0, 1500))
        end = None if rnd.random() < 0.2 else start + dt.timedelta(days=rnd.randint(-10, 60))
        out.append((owner, concept, start, end))
    return out


@pytest.mark.parametrize("horizon", [365, 30, 100])
def test_transitions_match_brute_force(spark, horizon):
    data = random_records(horizon)
    want = Counter()
    days = defaultdict(set)
    for o, c, s, _ in data:
        days[o].add((c, s))
    for recs in days.values():
        for ca, sa in recs:
            for cb, sb in recs:
                if ca != cb and 0 < (sb - sa).days <= horizon:
                    want[ca, cb] += 1
    df = spark.createDataFrame(data, SCHEMA)
    got = {(a, b): n for a, b, n in rows(pairs.transition_counts(df, "uuid", "concept", "start", horizon))}
    assert got == dict(want)


def test_transition_boundaries(spark):
    data = [
        ("p", "A", date("2000-01-01"), None),
        ("p", "B", date("2000-12-31"), None),   # 365 days after A
        ("p", "C", date("2001-01-01"), None),   # 366 days after A
        ("p", "D", date("2000-01-01"), None),   # same day as A
        (None, "A", date("2000-01-01"), None),
        ("p", None, date("2000-01-02"), None),
    ]
    got = rows(pairs.transition_counts(spark.createDataFrame(data, SCHEMA), "uuid", "concept", "start"), "item_a", "item_b")
    assert got == [("A", "B", 1), ("B", "C", 1), ("D", "B", 1)]


def test_transition_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(random_records(5), SCHEMA)
    out = pairs.transitions(df, "uuid", "concept", "start", k=1000).collect()
    totals = defaultdict(int)
    for r in out:
        totals[r.item_a] += r.transitions
    assert all(totals[r.item_a] == r.total_from_a for r in out)


@pytest.mark.parametrize("distinct", [True, False])
def test_cooccurrence_matches_brute_force(spark, distinct):
    data = random_records(11)
    by_owner = defaultdict(list)
    for o, c, *_ in data:
        by_owner[o].append(c)
    want = Counter()
    for items in by_owner.values():
        pool = sorted(set(items)) if distinct else sorted(items)
        for a, b in combinations(pool, 2):
            if a < b:
                want[a, b] += 1
    df = spark.createDataFrame(data, SCHEMA)
    got = {(a, b): n for a, b, n in rows(pairs.cooccurrence(df, "uuid", "concept", 1000, distinct))}
    assert got == dict(want)


def test_cooccurrence_ties_are_cut_in_name_order(spark):
    data = [(o, c, date("2000-01-01"), None) for o in ("p", "q") for c in "DCBA"]
    got = rows(pairs.cooccurrence(spark.createDataFrame(data, SCHEMA), "uuid", "concept", 2))
    assert got == [("A", "B", 2), ("A", "C", 2)]


def test_recurrence_gaps_match_brute_force(spark):
    data = random_records(3)
    groups = defaultdict(list)
    for o, c, s, e in data:
        groups[o, c].append((s, e is None, e or dt.date.max))
    gaps = defaultdict(list)
    for (_, c), recs in groups.items():
        recs.sort()
        for (_, is_open, e), (s, _, _) in zip(recs, recs[1:]):
            if not is_open and (s - e).days > 0:
                gaps[c].append((s - e).days)
    got = {c: g for c, g in rows(pairs.recurrence_gaps(spark.createDataFrame(data, SCHEMA), "uuid", "concept", "start", "end"))}
    assert set(got) == set(gaps)
    for c, g in gaps.items():
        assert got[c] == pytest.approx(sum(g) / len(g))


def test_recurrence_gap_needs_positive_gap(spark):
    data = [
        ("p", "once", date("2000-01-01"), date("2000-01-05")),
        ("p", "overlap", date("2000-01-01"), date("2000-02-01")),
        ("p", "overlap", date("2000-01-15"), date("2000-02-15")),
        ("p", "back", date("2000-01-01"), date("2000-01-05")),
        ("p", "back", date("2000-01-15"), None),
        ("p", "back", date("2000-03-01"), None),  # previous one is still open
    ]
    got = rows(pairs.recurrence_gaps(spark.createDataFrame(data, SCHEMA), "uuid", "concept", "start", "end"))
    assert got == [("back", 10.0)]


def test_repeat_visit_days(spark):
    data = [
        ("same_day", "2000-01-01"), ("same_day", "2000-01-01"),
        ("day30", "2000-01-01"), ("day30", "2000-01-31"), ("day30", "2000-02-02"),
        ("day31", "2000-01-01"), ("day31", "2000-02-01"),
    ]
    df = spark.createDataFrame([(o, date(d)) for o, d in data], "uuid string, d date")
    assert rows(pairs.repeat_visit_days(df, "uuid", df.d)) == [("day30", date("2000-01-31"))]
