"""Secret scans over versions of files with a ledger of content-addressed blobs. DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.llm.common import stored, unused


class Rule(NamedTuple):
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Runs of one class of characters are matched with their least length in the pattern: a shorter run holds no match either way.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE_RULES, *MORE_RULES)
MASK = "[secret]"
FINDING = "blob string, kind string, kind_no int, start long, end long"


def rules_version(rules: Sequence[Rule]) -> str:
    """A name of the rules that changes with any of them."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def blob_id(content: Column) -> Column:
    """The address of a content: its SHA-256; NULL is the empty content."""
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def find(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, kind, kind_no, start, end) of every match in ``blobs`` (blob, content): code points, end exclusive.

    Matches of a kind are leftmost and do not overlap. A text is split at the matches of a kind; the lengths of the pieces and of the
    matches add up to their places. The same blob given more than once is found once.
    """
    columns = [F.col("blob")]
    for i, rule in enumerate(rules):
        columns.append(F.split("content", rule.pattern, -1).alias(f"parts{i}"))
    split = blobs.select("content", *columns).where(" OR ".join(f"size(parts{i}) > 1" for i in range(len(rules))))
    found = []
    for i, rule in enumerate(rules):
        matches = F.when(F.size(f"parts{i}") > 1, F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(0))).otherwise(
            F.array().cast("array<string>")
        )
        pieces = F.zip_with(
            F.slice(f"parts{i}", 1, F.size(f"parts{i}") - 1), matches,
            lambda part, match: F.struct(
                F.lit(rule.kind).alias("kind"), F.lit(i).alias("kind_no"), F.length(part).cast("long").alias("before"),
                F.length(match).cast("long").alias("length"),
                (F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least).alias("counts"),
            ),
        )
        found.append(F.transform(pieces, lambda x, n: F.struct(n.alias("n"), x.alias("m"))))
    rows = (
        split.select("blob", F.explode(F.concat(*found)).alias("f")).select("blob", "f.n", "f.m.*")
        .repartition("blob").dropDuplicates(["blob", "kind_no", "n"])
    )
    order = Window.partitionBy("blob", "kind_no").orderBy("n")
    end = F.sum(F.col("before") + F.col("length")).over(order)
    return rows.withColumn("end", end).where("counts").select("blob", "kind", "kind_no", (F.col("end") - F.col("length")).alias("start"), "end")


class Ledger:
    """What has been scanned, in ``path``: the blobs of each version of the rules, and the findings in them."""

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[Rule] = RULES):
        self.spark, self.path, self.rules, self.version = spark, path.rstrip("/"), tuple(rules), rules_version(rules)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/rules={self.version}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string")

    def findings(self) -> DataFrame:
        """Findings of these rules; those that a stopped run has left twice are given once."""
        return self._read("findings", FINDING).distinct()

    def scan(self, versions: DataFrame, key: Sequence[str], content: str = "content") -> DataFrame:
        """Scan what is new in ``versions`` (key columns, content); returns (key columns, blob) of all versions.

        A blob is new if these rules have not seen it. The text of one version of each new blob is read, however many versions or
        paths have it: the least key; rows that share it are one version. NULL is an empty text, keys may be NULL. Findings are written before the blobs count as scanned, so a stopped run is repeated.
        An empty table adds nothing and gives an empty one.
        """
        named = stored(versions.select(*key, blob_id(F.col(content)).alias("blob")), "blobs")
        new = named.groupBy("blob").agg(F.min(F.struct(*key)).alias("first")).join(self.scanned(), "blob", "left_anti")
        new = stored(new.select(F.col("blob").alias("_blob"), F.lit(True).alias("_new"), *(F.col(f"first.{c}").alias(f"_{c}") for c in key)), "new-blobs")
        texts = versions.select(*key, F.coalesce(F.col(content), F.lit("")).alias("content"), blob_id(F.col(content)).alias("blob"))
        # ids alone are built into hash tables; the texts are shuffled once and never sorted. What is scanned takes a column of either
        # side, so that the optimizer cannot move the scan before the join, where it would read known blobs too
        same = [F.col("blob") == F.col("_blob"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key)]
        texts = texts.join(new.hint("shuffle_hash"), same).select("blob", F.when(F.col("_new"), F.col("content")).alias("content"))
        find(texts, self.rules).write.mode("append").parquet(f"{self.path}/findings/rules={self.version}")
        new.select(F.col("_blob").alias("blob")).write.mode("append").parquet(f"{self.path}/scanned/rules={self.version}")
        return named

    def spans(self) -> DataFrame:
        """(blob, found): the findings of each blob that has any, by start and kind; a blob's are bounded by its text."""
        return self.findings().groupBy("blob").agg(
            F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind"))).alias("found")
        )

    def findings_by_path(self, named: DataFrame) -> DataFrame:
        """``named`` (key columns, blob) with ``found``, the findings in the blob; an empty list where there are none."""
        none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
        return named.join(self.spans(), "blob", "left").withColumn("found", F.coalesce("found", none))


def redact(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with ``mask`` for each secret in ``text_col``; overlapping secrets share one mask.

    Rows without secrets, of which NULL texts are some, stay as they are, and so does the number of rows.
    """
    ledger.scan(docs, [id_col], text_col)
    before = F.max("end").over(Window.partitionBy("blob").orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, -1))
    cuts = (
        ledger.findings().withColumn("before", F.coalesce(before, F.lit(0)))
        .groupBy("blob").agg(
            F.array_sort(F.collect_list(F.struct("start", "kind_no", "before"))).alias("cuts"), F.max("end").alias("rest")
        )
    )
    of, cuts_of, rest_of = unused(docs, "_blob", "_cuts", "_rest")
    cuts = cuts.toDF(of, cuts_of, rest_of)
    marked = docs.withColumn(of, blob_id(F.col(text_col))).join(cuts, of, "left")

    def piece(cut: Column) -> Column:
        between = F.substring(text_col, (cut["before"] + 1).cast("int"), F.greatest(cut["start"] - cut["before"], F.lit(0)).cast("int"))
        own = (cut["start"] >= cut["before"]) | (cut["before"] == 0)
        return F.concat(between, F.when(own, mask).otherwise(""))

    rest = F.substring(text_col, (F.col(rest_of) + 1).cast("int"), F.length(text_col))
    text = F.when(F.col(cuts_of).isNotNull(), F.concat(F.array_join(F.transform(cuts_of, piece), ""), rest)).otherwise(F.col(text_col))
    return marked.withColumn(text_col, text).select(*docs.columns)
