"""Spelling variants against brute force; the query against its SQL is in test_pipeline_and_queries."""

import random

import pytest

from careflow.llm import spelling


def edits(word, letters):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def some_words(seed, letters, n, low, high):
    some = random.Random(seed)
    words = sorted({"".join(some.choice(letters) for _ in range(some.randint(low, high))) for _ in range(n)})
    some.shuffle(words)
    return words


CASES = [("ab", 200, 2, 9), ("abcé", 500, 6, 10), ("a", 9, 2, 12), ("abcdefghäöüñ×÷ÿÀ", 2000, 3, 5), ("abz", 1, 6, 6), ("ab", 300, 30, 34)]


@pytest.mark.parametrize("letters,n,low,high", CASES)
def test_both_halves_find_every_edit(letters, n, low, high):
    words = some_words(2, letters, n, low, high)
    asked = words + some_words(5, letters + "q", 20, low, high)
    index = spelling.Index(words)
    found = {(asked[i], words[j]) for half in (True, False) for i, j in zip(*index.near(asked, half))}
    assert found == {(q, e) for q in asked for e in edits(q, letters + "q") if e in set(words)}


def brute_groups(counts, ratio=5):
    letters = {c for w in counts for c in w}
    near = {w: sorted(e for e in edits(w, letters) if e in counts) for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda e: (-counts[e], e), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_groups(spark, block):
    """A small block cuts keys to parts and the words to many indexes; the result is the same."""
    some = random.Random(4)
    counts = {w: some.choice([5, 5, 6, 25, 30, 150, 4000, 4000]) for w in some_words(9, "abc", 400, 4, 8)}
    chain = {"zzzzzz": 5, "zzzzzy": 25, "zzzzyy": 125, "zzzyyy": 625, "zzyyyy": 3125, "zyyyyy": 15625, "yyyyyy": 78125}
    counts |= chain | {"hot" + w: 5 for w in some_words(11, "xyz", 300, 4, 5)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.group_variants(table, block=block).collect()]
    assert len(got) == len(counts) and set(got) == brute_groups(counts)
    assert {r[2] for r in got if r[0] in chain} == {"yyyyyy"}


def test_odd_rows(spark):
    rows = [("abcdef", 9, "x"), ("abcdef", 50, "y"), (None, 3, "x"), ("abcdeg", None, "x"), ("abcdeh", 5, None), ("", 9, "x"), ("a", 9, "x"), ("y" * 5000, 7, "x"), ("y" * 4999, 70, "x")]
    table = spark.createDataFrame(rows, "word string, n long, near string")
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(table).collect()}
    assert got == {
        "abcdef": (None, "abcdef", 50, 1, None), "abcdeh": ("abcdef", "abcdef", 5, 1, 50), "y" * 5000: ("y" * 4999, "y" * 4999, 7, 1, 70), "y" * 4999: (None, "y" * 4999, 70, 1, None),
    }
    assert spelling.group_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(table, ratio=1)


def test_runs(spark):
    table = spark.createDataFrame([(None,), ("",), ("ABCDEFg abcde Éàçñß÷×x1ÀÉABCDEF\n",), ("z" * 100_000,)], "text string")
    got = [r[0] for r in table.select(spelling.runs(table["text"])).collect()]
    assert got == [[], [], ["abcdefg", "Éàçñß÷×x", "ÀÉabcdef"], ["z" * 100_000]]
