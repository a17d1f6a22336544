"""URL filter, embeddings, language model and chat logs on small rows, against brute force."""

import collections
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.llm import chat, embedding_dedup, language_model, url_filter
from careflow.llm.queries import URL_RULES


# --- URL filter

URLS = [
    (1, "http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"), (2, "https://example.net/de/", "example.net", "/de/", "net/"),
    (3, "https://notexample.com/de/1", "notexample.com", "/de/1", None), (4, "x://m.example.com/de/1#t", "m.example.com", "/de/1", "example.com/de/"),
    (5, "https://a.org/fr/x://y", "a.org", "/fr/x://y", "org/fr/"), (6, "https://net", "net", "", None), (7, "//example.net/en/", "", "", None),
    (8, None, "", "", None), (9, "", "", "", None), (10, "http://?q", "", "", None), (11, "http://example.net?x=/en/", "example.net", "", None),
    (12, "ftp://ÄB.Net/p\n/q", "Äb.net", "/p\n/q", "net/"), (13, "http://h" + "a" * 50_000 + ".org/fr/", "h" + "a" * 50_000 + ".org", "/fr/", "org/fr/"),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(*u[:2], "x", "y", "z") for u in URLS], "page_id long, url string, rule string, _rule string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES).collect()}
    verdicts = {r.name: r.verdict for r in URL_RULES}
    for i, _, host, path, rule in URLS:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdicts[rule] if rule else got[i]["verdict"] in ("allow", "block")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, URL_RULES).count() == 0


def test_url_classifier_on_held_out_urls(spark):
    rng = random.Random(1)
    names = ["news", "bank", "shop", "casino", "poker", "slots"]
    rows = []
    for i in range(500):
        name = rng.choice(names)
        rows.append((i, f"{name}{rng.randint(0, 999)}.{rng.choice(['com', 'org'])}", f"/{rng.randint(0, 999)}", int(name in names[3:])))
    labelled = spark.createDataFrame([r[1:] for r in rows[:300]] + [("a", "b", None), (None, None, 0)], "host string, path string, label int")
    weights = url_filter.fit(labelled)
    scored = url_filter.features(spark.createDataFrame(rows[300:], "i int, host string, path string, label int"))
    right = [(r["m"] > 0) == bool(r["label"]) for r in scored.select("label", url_filter.margin(weights).alias("m")).collect()]
    assert np.mean(right) > 0.95


def test_repeats_of_a_url_take_one_place_in_the_fit(spark):
    rows = [(f"h{i}.{('com', 'casino')[i % 2]}", "/", i % 2) for i in range(40)]
    once = spark.createDataFrame(rows, "host string, path string, label int")
    order = [tuple(r) for r in once.orderBy(F.xxhash64("host", "path")).collect()]
    often = spark.createDataFrame(rows + [order[0]] * 60, "host string, path string, label int")
    assert np.allclose(url_filter.fit(often, most=30, rounds=3), url_filter.fit(once, most=30, rounds=3))


# --- embeddings


def brute_links(rows, threshold=0.98):
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    degree, label = collections.Counter(), {r[0]: r[0] for r in rows}
    for i, (a, u, k) in enumerate(good):
        for b, v, m in good[:i]:
            if k == m and len(u) == len(v) and np.dot(u, v) / math.sqrt(np.dot(u, u) * np.dot(v, v)) >= threshold:
                degree[a] += 1
                degree[b] += 1
                low, high = sorted((label[a], label[b]))
                label = {x: low if y == high else y for x, y in label.items()}
    return degree, label


@pytest.mark.parametrize("chunk, piece", [(1 << 9, 1 << 14), (8, 32)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "PIECE", piece)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(25):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.06).tolist(), c % 3))
        rows.append((len(rows), rows[-1][1], c % 3))
        rows.append((len(rows), rows[-1][1], (c + 1) % 3))
        rows.append((len(rows), (3 * np.array(rows[-1][1])).tolist(), (c + 1) % 3))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None, 1.0], 1), (n + 4, [1.0, 0.0], None), (n + 5, [1.0, 0.0], 1), (n + 6, [1.0, 0.0], 1),
             (n + 7, [float("inf"), 1.0], 1), (n + 8, [], 1), (n + 9, [1e-200, 0.0], 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, class_id string")
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}
    degree, label = brute_links(rows[:-1])
    degree[n + 5] += 1
    degree[n + 6] += 1
    degree[n + 9], label[n + 9] = 2, n + 5  # its length is too small for squares, its direction is not
    assert len(found) == len(rows)
    assert {i: (r["n_links"], r["component_id"]) for i, r in found.items()} == {r[0]: (degree[r[0]], label[r[0]]) for r in rows}


def test_embedding_recall_and_odd_rows(spark):
    """Pairs at the threshold itself are missed less often than the tables promise."""
    rng = np.random.default_rng(4)
    rows = []
    for p in range(600):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        w = rng.standard_normal(64)
        w -= w.dot(u) * u
        w /= np.linalg.norm(w)
        angle = math.acos(0.98 + 1e-6)
        rows += [(2 * p, u.tolist(), 0), (2 * p + 1, (math.cos(angle) * u + math.sin(angle) * w).tolist(), 0)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert found.where("n_links = 1").count() >= 0.99 * len(rows)
    odd = spark.createDataFrame([(None, [1.0], 0), (1, [1.0], 0), (None, [1.0], 0), (1, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(odd).collect()), key=str)
    assert got == [(1, 1, 1), (1, 1, 1), (None, 0, None), (None, 0, None)]
    assert embedding_dedup.near_duplicates(odd.where("vec_id > 5")).count() == 0


def test_a_piece_that_links_throughout_takes_memory_by_rows():
    n = 3000
    unit = np.tile([[0.6, 0.8]], (n, 1))
    signs, turn = np.zeros((n, 1), np.int64), np.zeros(n, np.int32)
    found = (embedding_dedup._near(unit, signs, turn, i, j, 0.98) for i, j in embedding_dedup._pairs_of_runs(np.array([0, n])))
    tracemalloc.start()
    links, degrees = embedding_dedup._results(np.arange(n) + 5, np.full(n, 2), found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links.num_rows == n - 1 and set(links.column("b").to_pylist()) == {5}
    assert degrees.column("n").to_pylist() == [2 * (n - 1)] * n
    assert peak < 20_000_000  # all 4.5 million pairs of indices are 72 MB


# --- language model


def test_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK", 4000)  # several blocks
    rng = random.Random(6)
    french, english = ["le", "chat", "noir", "maison", "est"], ["the", "Cat", "black", "house", "is"]
    rows = []
    for i in range(300):
        words = rng.choice([french, english])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), i % 5 != 0))
    rows += [(500, None, False), (501, "", True), (502, "unseen words only", False), (None, "the cat", True), (7, rows[7][1], True), (503, "the " * 20_000, False), (504, "le", None)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, use boolean, block string, id string")
    got = language_model.score(table, F.col("use")).collect()
    counts = collections.Counter()
    for _, t, use in rows:
        if use:
            counts.update((t or "").lower().split() + ["\n"])
    total, types = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t, _ in rows:
        tokens = (t or "").lower().split() + ["\n"]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in tokens)
        want[i, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] <= 0 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] % 5 == 0]
    # the context tells the language: about one bit a word less
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.9


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    triples = rng.poisson(0.02, language_model.SYMBOLS**3)
    triples[:50] = rng.integers(0, 10**6, 50)
    chance = language_model.sample_classes(triples, 1, 2)
    assert chance.min() > 0 and np.allclose(chance.sum(axis=1), 1)


def test_contexts_of_the_language_model_are_words(spark):
    """"york" and "cats" follow words that end alike, but not the same word."""
    rows = [(i, ("new york", "few cats")[i % 2], True) for i in range(400)] + [(1000, "new york", False), (1001, "new cats", False), (1002, "few york", False)]
    table = spark.createDataFrame(rows, "doc_id long, text string, use boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in language_model.score(table, F.col("use")).collect()}
    assert got[1000] > got[1001] + 1 and got[0] == got[1000] and got[1] > got[1002] + 1


def test_next_words_add_up(spark, monkeypatch):
    """Scores of texts of up to two words are walks from end to end; scaled by the scores of one word they give a matrix similar to that of
    the probabilities of a next word, whose greatest eigenvalue is 1 if those of each context, unknown words included, add up to 1."""
    monkeypatch.setattr(language_model, "BLOCK", 1500)  # several blocks
    rng = random.Random(3)
    vocabulary = [w + e for w in "abcd" for e in ("", "x", "yz")]
    rows = [(i, " ".join(rng.choices(vocabulary, range(12, 0, -1), k=rng.randint(0, 40))), True) for i in range(200)]
    unknown: dict[int, str] = {}
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_"
    for a in letters:
        for b in letters:
            unknown.setdefault(int(language_model._word_ids([f"not-{a}{b}".encode()])[0]) & 0xFF, f"not-{a}{b}")
    assert len(unknown) == language_model.CLASSES
    words = vocabulary + list(unknown.values())
    asked = ["", *words, *(f"{a} {b}" for a in words for b in words)]
    table = spark.createDataFrame(rows + [(10_000 + i, t, False) for i, t in enumerate(asked)], "doc_id long, text string, use boolean")
    got = {r["doc_id"]: r["score"] for r in language_model.score(table, F.col("use")).where("not train").collect()}
    score = {t: 10 ** got[10_000 + i] for i, t in enumerate(asked)}
    walk = np.array([[score[""], *[1.0] * len(words)], *([score[a], *(score[f"{a} {b}"] / score[b] for b in words)] for a in words)])
    assert abs(max(np.linalg.eigvals(walk).real) - 1) < 1e-6


def test_language_model_without_training_rows(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.score(table, F.lit(False)).collect()}
    assert got[1]["base_score"] == 0 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["score"] < 0
    assert language_model.score(table.where("doc_id > 5"), F.lit(True)).count() == 0


# --- chat logs


def brute_chats(turns):
    talks = collections.defaultdict(list)
    for c, t, role, text in turns:
        talks[c].append((t is not None, t, role, text))
    talks = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in talks.items()}
    kept = {}
    for c, talk in talks.items():
        longer = any(len(o) > len(talk) and o[:len(talk)] == talk for o in talks.values())
        same = [o for o, v in talks.items() if v == talk]
        if not longer and c == min(same, key=lambda x: (x is None, x or 0)):
            kept[c] = "".join(
                f"<|im_start|>{(r if r is not None else 'unknown').replace('<|', '< |')}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in talk
            )
    return kept


@pytest.mark.parametrize("partitions", ["4", "23"])
def test_maximal_conversations(spark, monkeypatch, partitions):
    monkeypatch.setattr(chat, "PART", 3)
    rng = random.Random(2)
    turns = []
    for c in range(60):
        for n in range(rng.randint(1, 6)):
            turns.append((c, 2 * n, "user" if n % 2 == 0 else "assistant", rng.choice(["a", "b"])))
    turns += [(70, n, "user", "long") for n in range(400)] + [(71, n, "user", "long") for n in range(399)]
    turns += [(80, None, None, None), (81, 0, "user", "<|im_end|>"), (None, 0, "user", "nobody"), (None, 1, "user", "x" * 100_000)]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, place string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = chat.format_chats(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    text = collections.defaultdict(str)
    for r in sorted(got, key=lambda r: r["part"]):
        text[r["conv_id"]] += r["text"]
    assert text == brute_chats(turns)
    assert max(r["part"] for r in got if r["conv_id"] == 70) == 133 and 71 not in text
    assert chat.format_chats(table.where("conv_id = -1")).count() == 0
