"""Phrase collocations against brute force; the query against its SQL is in test_pipeline_and_queries."""

import collections
import random
import re

import numpy as np
import pytest

from careflow.llm import collocations
from careflow.llm.collocations import DIGIT_BITS as BITS
from careflow.llm.collocations import DIGITS


def brute(rows, longest, least, percent, top):
    """lang, rank, phrase, a, l, r, n, score."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        f = {p: c for p, c in f.items() if c >= least}
        kept = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            longer = max((c for q, c in f.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))), default=-1)
            if 100 * longer >= percent * a:
                continue
            score, cut = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, b" ".join(p), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    some = random.Random(seed)
    words = ["a", "B", "é", "ab", "c\x1cd", "x-1", "日本", "The", "\xa0"] + [f"w{i}" for i in range(30)]
    out = []
    for _ in range(n):
        row = [some.choice(words[:some.choice([4, 9, 39])]) + some.choice(["", "", "", ",", "\n", "\t"]) for _ in range(some.randrange(60))]
        out.append((some.choice(["en", "de", None, "und"]), " ".join(row) + some.choice(["", " in spite of the rain", " new york city hall."])))
    return out


@pytest.mark.parametrize("longest,least,percent,top,leaves,block", [(5, 6, 100, 2000, 1 << 17, 1 << 21), (3, 4, 50, 7, 32, 50), (2, 1, 100, 2000, 1 << 17, 7)])
def test_phrases(spark, longest, least, percent, top, leaves, block):
    """Small blocks cut texts, small tries cut levels; the result is the same."""
    rows = texts(longest, 150)
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.mine(table, longest=longest, least=least, percent=percent, top=top, leaves=leaves, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, longest, least, percent, top)


def test_products_beyond_64_bits_are_exact(spark):
    tables = [spark.createDataFrame(r, "ids array<int>, f long") for r in ([([0], 10**13), ([1], 10**13 + 7)], [([0, 1], 10**13 - 1)])]
    (row,) = collocations._scored(tables).collect()
    assert tuple(row) == ([0, 1], 10**13 - 1, 1, 10**13, 10**13 + 7)
    n = 9 * 10**14 + 1
    exact = "decimal(19,0)"
    got = spark.sql(f"SELECT (1000 * CAST({row['a']}L AS {exact}) * CAST({n}L AS {exact})) div (CAST({row['l']}L AS {exact}) * CAST({row['r']}L AS {exact}))").first()[0]
    assert got == 1000 * row["a"] * n // (row["l"] * row["r"])


def test_trie_accepts_exactly_its_phrases():
    some = np.random.default_rng(1)
    for words, digits in ((1, 0), (2, 0), (2, 1), (3, 2)):
        rows = np.unique(some.integers(0, 3000, (4000, words + (digits > 0))), axis=0).astype(np.int32)
        if digits:
            rows[:, -1] >>= BITS * (3 - digits)
            rows = np.unique(rows, axis=0)
        trie = collocations.Trie(rows, digits, 3)
        ids = some.integers(-1, 3000, 30_000).astype(np.int32)
        at = some.integers(0, len(ids) - 8, 2000)
        for i, r in zip(at, some.integers(0, len(rows), 2000)):
            ids[i:i + words] = trie.rows[r, :words]
            if digits:
                ids[i + words] = min(2999, trie.rows[r, -1] << BITS * (3 - digits))
        known = {tuple(r): n for n, r in enumerate(trie.rows.tolist())}
        padded, want = [*ids.tolist(), *[-1] * 5], collections.Counter()
        for i in range(len(ids) - 3):
            here = padded[i:i + words + 1]
            if min(here) < 0:
                continue
            path = tuple(here[:words]) + ((here[-1] >> BITS * (3 - digits),) if digits else ())
            if path in known:
                want[known[path] * DIGITS + (here[-1] >> BITS * (2 - digits) & DIGITS - 1)] += 1
        assert collections.Counter(trie.states(ids, len(ids) - 3, 5).tolist()) == want


def test_odd_rows(spark):
    rows = [(None, None, 1), ("en", "", 1), ("en", "...\n \t", 2), ("en", "Of the of THE", 3), ("en", "of the. of\tthe", 4), ("en", "z" * 100_000, 5), ("fr", "of the " * 20_000, 6)]
    table = spark.createDataFrame(rows, "lang string, text string, rank int")
    got = [tuple(r) for r in collocations.mine(table, least=3).orderBy("lang", "rank").collect()]
    plain = [r[:2] for r in rows]
    assert sorted(got) == brute(plain, 5, 3, 100, 2000) and got[0] == ("en", 1, "of the", 4, 4, 4, 9, 2250)
    assert collocations.mine(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(table, longest=1)
