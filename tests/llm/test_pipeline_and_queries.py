"""The pipeline's stages against brute force, on odd rows, and the corpus queries with SQL."""

import collections
import hashlib
import importlib
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from check_oracles import compare, database
from pyspark.sql import functions as F
from test_text_operators import ODD, brute_fingerprint, brute_sets, brute_spans, brute_targets, docs

import corpus_pipeline
from careflow.llm import toxicity
from careflow.llm.queries import ORACLES, QUERIES, tokenizer_file

ROOT = Path(__file__).resolve().parents[2]
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage keeps of the small documents, by name."""
    out, base = {}, tmp_path_factory.mktemp("stages")
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out["documents"] = table.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, SF_DIR).write.parquet(f"{base}/{name}")
        table = spark.read.parquet(f"{base}/{name}")
        out[name] = table.collect()
    return out


def test_toxic_documents_go(spark, staged):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = table.select("doc_id", toxicity.scorer(table, model)(F.col("text")).alias("s")).collect()
    assert {r["doc_id"] for r in staged["toxicity"]} == {r["doc_id"] for r in scores if r["s"] < 0.5}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(label[r["doc_id"]] == 1 for r in scores if r["s"] >= 0.5 and r["doc_id"] in label)


def test_one_of_each_group_stays(staged):
    rows = sorted(staged["toxicity"], key=lambda r: r["doc_id"])
    group = brute_sets([brute_fingerprint(r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in staged["simhash_near_dedup"]) == [rows[i]["doc_id"] for i in sorted(set(group))]


def test_secrets_are_masked(staged):
    before = {r["doc_id"]: r for r in staged["simhash_near_dedup"]}
    assert before.keys() == {r["doc_id"] for r in staged["secret_scan"]}
    for r in staged["secret_scan"]:
        if not brute_spans(before[r["doc_id"]]["text"]) and "eyJ" not in r["text"] and "PRIVATE KEY" not in r["text"]:
            assert r == before[r["doc_id"]]
        else:
            assert "[secret]" in r["text"] and not brute_spans(r["text"].replace("[secret]", " ")) and r["n_chars"] == len(r["text"])


def test_sources_are_mixed(staged):
    rows, sizes = staged["secret_scan"], collections.Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    target = brute_targets(sizes)
    want = collections.Counter()
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        draw = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        want[r["doc_id"]] = int(rate) + (draw < rate - int(rate))
    got = collections.Counter(r["doc_id"] for r in staged["source_mixing"])
    # a draw within rounding of its rate may fall either way
    assert sum(got[i] != want[i] for i in want) == 0


def test_ids_are_those_of_the_library(staged):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    text = {r["doc_id"]: r["text"] for r in staged["source_mixing"]}
    assert len(staged["bpe_encoding"]) == len(staged["source_mixing"])
    for r in staged["bpe_encoding"]:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(ids)


def test_run_is_the_stages(spark, staged):
    got = collections.Counter((r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert got == collections.Counter((r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in staged["bpe_encoding"])


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = docs(spark, ODD, extra=True, sources=[None, "", "a", "a", "b", "b", None, "b", "c", "c", "ü", "c"])
    for table, n in ((odd, 8), (odd.limit(0), 0)):
        columns = table.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            table = stage(spark, table, str(tmp_path))
            rows = table.collect()
            if k < 4:
                assert table.columns == columns
            if k in (1, 2):
                assert len(rows) == n
            table = spark.createDataFrame(rows, table.schema)
        assert bool(rows) == bool(n)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), database(SF_DIR), ORACLES[name]) is None


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    numbers = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(numbers) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_corpus_operators(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('careflow.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name=name)\n"
        f"sys.meta_path.insert(0, Gone()); sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
        "assert set(e.oracle_sql()) == set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path)
