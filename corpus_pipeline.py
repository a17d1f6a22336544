"""From raw documents to token ids: toxicity, near duplicates, secrets, source mix, BPE. See STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm import bpe, mixing, secret_scan, simhash, toxicity
from careflow.llm.common import ship_package
from careflow.llm.queries import tokenizer_file
from careflow.sources.store import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on those that ``labels`` names, scores below one half; NULL and empty texts stay."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (four-word shingles) are linked within 4 bits: the one with the smallest id.

    NULL, empty and blank texts share the fingerprint zero and so are one group with all that differ from it in 4 bits or fewer; of
    repeated rows one stays; an empty table gives an empty one.
    """
    return simhash.keep_one(docs, budget=4, width=4)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask for each secret in the text and ``n_chars`` of the new text; NULL and empty texts stay, as do repeated rows."""
    masked = secret_scan.redact(docs, secret_scan.Ledger(spark, scratch_path(spark, "ledger")))
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit(secret_scan.MASK)), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate says; NULL and empty texts have size 0, a NULL source is a source."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each row; the ids, little-endian unsigned 32-bit integers, decode to the text. NULL and empty texts have none."""
    ids = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_file())
    return ids.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]
#: The classifier of the first stage is not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each but the last is written to the shared folder and read again. An empty table gives an empty one."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
