"""The registered queries without SQL, over whole small tables, against brute force."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from test_text_operators import brute_fingerprint, brute_sets

from careflow.llm.queries import QUERIES, tokenizer_file

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def test_simhash_components(spark, texts):
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    sets = brute_sets(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash_near_dedup"](spark, SF_DIR).collect()}
    assert got == {i: (f"{f:016x}", ids[s]) for i, f, s in zip(ids, prints, sets)}


def test_url_rules(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()}
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    got = {r["page_id"]: r for r in QUERIES["op2_url_filter"](spark, SF_DIR).collect()}
    assert got.keys() == pages.keys()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, url in pages.items():
        _, found, rest = (url or "").partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = (rest[:cut].translate(lower), rest[cut:]) if found else ("", "")
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fitting = [
            r for r in rules
            if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])
        ]
        rule = max(fitting, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == rules[rule] if rule else got[i]["verdict"] in ("allow", "block")


def test_bpe_round_trip(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    library.no_truncation()
    library.no_padding()
    got = {r["doc_id"]: r for r in QUERIES["op5_bpe_round_trip"](spark, SF_DIR).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_toxicity_of_held_out_rows(spark):
    """On the next larger tables: the smallest have 19 labelled rows that are held out."""
    folder = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op7_toxicity"](spark, folder).collect()}
    assert got.keys() == {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in label if i in got and got[i]["held_out"] and label[i] is not None]
    assert len(held) >= 50 and sum(got[i]["predicted"] == label[i] for i in held) >= 0.95 * len(held)
    clean = [i for i in held if label[i] == 0]
    assert sum(got[i]["predicted"] for i in clean) <= 0.02 * len(clean)


def test_language_model_counts(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    counts = collections.Counter(w for i, found in tokens.items() if not held[i] for w in found)
    total, types = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in QUERIES["op8_language_model"](spark, SF_DIR).collect()}
    assert got.keys() == texts.keys()
    for i, found in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(found), sum(counts[w] > 0 for w in found), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in found), rel_tol=1e-9)
        assert r["score"] <= 0
    known = [i for i in texts if held[i]]
    assert sum(got[i]["score"] for i in known) > sum(got[i]["base_score"] for i in known)


def shingles(text):
    words = text.encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return (len(a & b) / len(a | b) if a | b else 1.0), len(a | b)


def test_fingerprints_of_edited_texts(spark, texts):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    got = {r["doc_id"]: r for r in QUERIES["op9_document_fingerprints"](spark, SF_DIR).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        r, other, cut = got[i], texts[after[i]], len(text) // 3
        edited = text[:len(text) - cut] + other[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, b in (("near_edited", edited), ("near_next", other)):
            exact, size = likeness(text, b)
            # exact while the union fits in a sketch, else four standard errors of a sketch of 128
            assert abs(r[column] - exact) <= (1e-9 if size <= 128 else 4 * max(0.02, math.sqrt(exact * (1 - exact) / 128)))
    same = collections.defaultdict(set)
    for i, text in texts.items():
        same[text].add(got[i]["fingerprint"])
    assert all(len(f) == 1 for f in same.values())


def test_toxicity_is_fitted_on_a_bounded_number_of_rows(spark):
    """However often labelled ids are repeated; NULL texts and ids do no harm."""
    from careflow.llm import toxicity

    docs = spark.range(20_000).selectExpr("id % 2 AS doc_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('text ', id % 5) END AS text")
    docs = docs.union(spark.createDataFrame([(None, "x"), (3, None), (4, "only")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in (0, 1, 3, 4, 5)] + [(None, 1), (0, 0)], "doc_id long, toxic int")
    found = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", 8192).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("text 0", 0), ("text 0", 1), (None, 1), ("only", 0)], key=str)
    assert toxicity.labelled(docs, labels, "doc_id", "text", "toxic", 1).count() <= 1
