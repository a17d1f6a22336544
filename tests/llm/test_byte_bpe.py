"""Byte-level BPE by ranks: equal to the library whatever the chunks, on odd rows and as the registered query."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_text_operators import ODD, docs

from careflow.llm import byte_bpe
from careflow.llm.queries import QUERIES, rank_file

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(rank_file()) as file:
        return byte_bpe.Ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def ids(value):
    return np.frombuffer(value, "<u4").tolist()


def test_every_character_and_long_words(ranks, library):
    for low in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000)
        assert ids(ranks.encode(text)) == library.encode_ordinary(text)
    some = random.Random(3)
    for text in ("a" * 5000, "ab" * 3000 + "é" * 2000, " " * 3000, "".join(some.choice("abcdefgh") for _ in range(20_000))):
        assert ids(ranks.encode(text)) == library.encode_ordinary(text)


def texts_to_cut():
    some, out = random.Random(7), []
    for letters in ("ab's re ll  \n\t1é中.,!'  x　", "ab c", "a ", "abcdefgh", "'rel ", "\n ", "1a.", "中文字。"):
        for n in (0, 1, 15, 16, 17, 24, 25, 64, 65, 200, 999):
            out.append("".join(some.choice(letters) for _ in range(n)))
            out.append("x" * n + "".join(some.choice(letters) for _ in range(n)) + " " * n)
    return out + [" 're" * 40, "'" * 77, "a'll" * 50, "a b" * 5 + "z" * 300 + " c" * 20 + "y" * 90 + "\n\n\n" * 30]


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (24, 24), (64, 4), (200, 16)])
def test_chunks_do_not_change_ids(spark, library, chunk, overlap):
    texts = texts_to_cut()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = byte_bpe.decode(byte_bpe.encode(table, rank_file(), chunk=chunk, overlap=overlap), rank_file()).collect()
    assert len(got) == len(texts)
    for r in got:
        assert ids(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()


def test_pieces_of_a_long_text_are_many(spark, ranks):
    """Spaces let scans meet in each overlap; a word longer than the overlap joins its chunks."""
    text = "word " * 200 + "z" * 150 + " end" * 100
    rows = [(1, i // 100, text[i:i + 120]) for i in range(0, len(text), 100)]
    scanned = [(k, n, *byte_bpe.borders(c, 100, 20, ranks)) for k, n, c in rows]
    parts = byte_bpe.stitch(spark.createDataFrame(scanned, "key long, n long, head array<int>, tail array<int>, firm boolean"), 100).collect()
    assert len(parts) == len(rows) and len({r["group"] for r in parts}) >= len(rows) - 2
    whole = "".join(rows[r["n"]][2][r["start"]:r["start"] + r["length"]] for r in sorted(parts, key=lambda r: r["n"]))
    assert whole == text


def test_odd_rows_and_clashing_columns(spark, library):
    for extra in (False, True):
        table = docs(spark, ODD, extra=extra).withColumns({c: F.lit("x") for c in ("_row", "_ids", "key", "group", "n")} if extra else {})
        got = byte_bpe.encode(table, rank_file(), chunk=1000, overlap=50)
        assert set(table.columns) - {"text"} <= set(got.columns)
        got = sorted((r["doc_id"] or 0, ids(r["ids"])) for r in got.collect())
        assert got == sorted((i or 0, library.encode_ordinary(t or "")) for i, t in ODD)
        assert byte_bpe.encode(table.limit(0), rank_file()).count() == 0
    empty = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert [r["decoded"] for r in byte_bpe.decode(empty, rank_file()).collect()] == [None, b""]
    with pytest.raises(ValueError):
        byte_bpe.encode(table, rank_file(), overlap=2)


def test_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op11_byte_level_bpe"](spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
