"""URL filters: host and path rules, and a logistic regression on hashed character n-grams. DataFrame functions only."""

from __future__ import annotations

import json
import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import stored, unused

#: Lengths of the n-grams of host and path, and the buckets that their hashes fall in.
GRAMS, BUCKETS = (3, 4), 4096
#: Fitting reads at most so many distinct labelled URLs: those with the smallest hashes.
MOST_ROWS = 2048
ROUNDS, PENALTY = 40, 1e-3


class UrlRule(NamedTuple):
    """``verdict`` for a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, rule: str) -> UrlRule:
        host, slash, path = rule.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to ``?``, ``#`` or the end.

    Both are empty for NULL and for a URL without ``://``.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _gram(letters_of: str, kind: str, n: int):
    """The bucket of the n-gram of host or path at a place in its list of characters."""

    def bucket(at: Column) -> Column:
        letters = [F.get(letters_of, at + j) for j in range(n)]
        return F.pmod(F.xxhash64(F.lit(kind), *letters), F.lit(BUCKETS)).cast("int")

    return bucket


def features(pages: DataFrame, host_col: str = "host", path_col: str = "path", out: str = "features") -> DataFrame:
    """``pages`` with the buckets of all n-grams of host and path, each part between a start and an end mark.

    The bucket after the last is in every list and stands for the intercept. NULL is an empty part.
    """
    columns, lists = [], []
    parts = unused(pages, "_host", "_path")
    for part, name, kind in zip((host_col, path_col), parts, ("host", "path")):
        marked = F.concat(F.lit("^"), F.coalesce(F.col(part), F.lit("")), F.lit("$"))
        columns.append(F.split(marked, "").alias(name))
        for n in GRAMS:
            starts = F.sequence(F.lit(0), F.greatest(F.size(name) - n, F.lit(0)))
            lists.append(F.transform(starts, _gram(name, kind, n)))
    return pages.select("*", *columns).withColumn(out, F.concat(*lists, F.array(F.lit(BUCKETS)))).drop(*parts)


def margin(weights: Sequence[float], buckets: str = "features") -> Column:
    """The model's log-odds: the sum of the weights of the buckets over the root of their number, and the intercept."""
    table = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")  # as many numbers as buckets
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))
    intercept = F.lit(float(weights[BUCKETS]))
    return (total - intercept) / F.sqrt(F.size(buckets).cast("double")) + intercept


def fit(labelled: DataFrame, most: int = MOST_ROWS, rounds: int = ROUNDS, penalty: float = PENALTY) -> list[float]:
    """Weights of a logistic regression that tells ``label`` 1 from 0 on a small table of (host, path, label).

    At most ``most`` distinct rows are used, those with the smallest hashes; repeats and rows without a label are not. Spark sums the gradient by bucket, once a
    round, and the driver keeps the weights, whose number is fixed. An empty table gives zeros.
    """
    sample = labelled.where("label IS NOT NULL").select("host", "path", F.col("label").cast("int").alias("label")).distinct()
    sample = sample.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(most)
    rows = stored(features(sample).select("label", "features"), "labelled-urls")
    n = rows.count()
    weights, ahead = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    for k in range(rounds if n else 0):
        error = (1 / (1 + F.exp(-margin(ahead)))) - F.col("label")
        scale = F.when(F.col("bucket") == BUCKETS, 1.0).otherwise(1 / F.sqrt(F.col("size").cast("double")))
        gradient = (
            rows.select(error.alias("error"), F.size("features").alias("size"), "features")
            .select("error", "size", F.explode("features").alias("bucket"))
            .groupBy("bucket").agg(F.sum(F.col("error") * scale).alias("sum"))
        ).collect()
        new = [w * (1 - 2 * penalty) for w in ahead]
        for r in gradient:
            new[r["bucket"]] -= 2.0 * r["sum"] / n
        momentum = k / (k + 3)
        ahead = [b + momentum * (b - a) for a, b in zip(weights, new)]
        weights = new
    return weights


def judge(pages: DataFrame, rules: Sequence[UrlRule], labelled: DataFrame | None = None, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (allow or block), which replace columns of these names.

    A rule's verdict stands; where none fits, a URL whose score (probability of block) exceeds ``threshold`` is blocked. The classifier is
    trained on ``labelled`` (host, path, label: 1 to block), else on the URLs of ``pages`` that rules decide. No row is moved:
    rules and weights are constants of the plan. A NULL URL, or one without ``://``, has an empty host and path, which no rule fits; repeated rows are judged
    alike, URLs of any length whole; of rules that fit alike in length the first counts. An empty table gives an empty one.
    """
    rule, grams = unused(pages, "_rule", "_features")
    host, path = host_and_path(F.col(url_col))
    found = pages.withColumns({"host": host, "path": path})
    found = found.withColumn(rule, rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = found.where(F.col(rule).isNotNull()).select("host", "path", (F.col(f"{rule}.verdict") == "block").cast("int").alias("label"))
    weights = fit(labelled)
    scored = features(found, out=grams).withColumn("score", 1 / (1 + F.exp(-margin(weights, grams))))
    learned = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.withColumn("rule", F.col(f"{rule}.rule")).withColumn("verdict", F.coalesce(f"{rule}.verdict", learned)).drop(grams, rule)
