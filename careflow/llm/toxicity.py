"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import ship_package

#: Lengths of the n-grams, and the buckets that their hashes fall in.
GRAMS, BUCKETS = (3, 4, 5), 1 << 20
#: Fitting reads at most so many labelled rows: those with the smallest hashes of their ids.
MOST_ROWS = 8192
#: Unless ``fit`` is told otherwise: an n-gram is a feature if it occurs in so many of these rows, and its log-count ratio stands out by so many
#: standard errors; at most so many features, those that stand out most.
LEAST_ROWS, STANDS_OUT, MOST_FEATURES = 5, 4.0, 1 << 16
#: Rows of average make-up added to the counts of an n-gram before taking their ratio.
SMOOTHING = 2.0

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(text: str | None) -> np.ndarray:
    """The bucket of each n-gram of a text, with A-Z lower-cased, a space at either end and white space as spaces."""
    raw = f" {text or ''} ".translate(_PLAIN)
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ codes[i:len(codes) - n + 1 + i]) * _MIX
            h ^= h >> np.uint64(29)
        out.append((h & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


_PLAIN = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)} | dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


class Model:
    """Weight of each bucket (0 for n-grams that are no feature) and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        self.features, self.weights, self.intercept = features, weights, intercept

    def table(self) -> np.ndarray:
        table = np.zeros(BUCKETS, dtype=np.float32)
        table[self.features] = self.weights
        return table


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled ids, whose number bounds the broadcast; of rows with the same id the least text counts, NULL last."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("_id") == F.col("id"))
    return found.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("id").select("text", "label")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_ROWS,
    least_rows: int = LEAST_ROWS, stands_out: float = STANDS_OUT, most_features: int = MOST_FEATURES,
) -> Model:
    """Learn from the whole texts of ``docs`` that ``labels`` (id, label 0 or 1) names, at most ``most`` rows of them.

    An n-gram's log-count ratio compares the shares of toxic and of other rows that hold it. Those that stand out become
    features with the ratio as value, and a logistic regression with an L2 penalty weighs them: n-grams of at least ``least_rows`` rows whose
    ratio is ``stands_out`` standard errors or more, at most ``most_features``. Counting is done in Spark; what
    the driver fits is bounded by ``most`` rows and ``most_features``. Rows whose label is NULL are not used; without both labels
    the model has no feature and its intercept is the share of toxic rows. A row labelled twice is toxic if once.
    """
    ship_package(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text_col, label_col, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), dtype=np.int32)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[int(label > 0), np.unique(_buckets(text.as_py()))] += 1
                n[int(label > 0)] += 1
        found = np.flatnonzero(seen.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1).astype(np.int32)), *(pa.array(np.append(seen[i, found], n[i]).astype(np.int64)) for i in (1, 0))],
            names=["bucket", "toxic", "other"],
        )

    sums = rows.mapInArrow(count, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    of = sums.where("bucket = -1").first()
    toxic, other = (of["toxic"], of["other"]) if of else (0, 0)
    prior = (toxic + 0.5) / (toxic + other + 1.0)
    nothing = Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))
    if not toxic or not other:
        return nothing
    a, b = F.col("toxic") + F.lit(SMOOTHING * prior), F.col("other") + F.lit(SMOOTHING * (1 - prior))
    ratio = F.log(a / F.lit(float(toxic))) - F.log(b / F.lit(float(other)))
    kept = (
        sums.where("bucket >= 0").where(F.col("toxic") + F.col("other") >= least_rows)
        .select("bucket", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / a + 1 / b)).alias("stands_out"))
        .where(F.col("stands_out") >= stands_out).orderBy(F.desc("stands_out"), "bucket").limit(most_features)
    ).toPandas()
    if kept.empty:
        return nothing
    features, ratios = kept["bucket"].to_numpy(np.int32), kept["ratio"].to_numpy(np.float64)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(f[f >= 0]) for f in (shared.value[_buckets(t.as_py())] for t in batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f.tobytes() for f in found], pa.binary())], names=["label", "features"]
            )

    table = rows.mapInArrow(sparse, "label int, features binary").toPandas()
    parts = [np.frombuffer(f, dtype=np.int32) for f in table["features"]]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    column = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    weights, intercept = _regress(row, column, ratios, (table["label"].to_numpy() > 0).astype(float))
    return Model(features, (weights * ratios).astype(np.float32), intercept)


def _regress(row, column, ratios, label, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features scaled by ``ratios`` by accelerated gradient descent."""
    n, m = len(label), len(ratios)
    value = ratios[column]
    length = np.sqrt(np.maximum(1.0, np.bincount(row, value**2, minlength=n)))
    step = 1.0 / (0.25 * float((length**2).mean()) + penalty / n + 0.25)
    w, ahead, c, c_ahead = np.zeros(m), np.zeros(m), 0.0, 0.0
    for k in range(rounds):
        margin = np.bincount(row, value * ahead[column], minlength=n) + c_ahead
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label
        gradient = np.bincount(column, value * error[row], minlength=m) / n + penalty / n * ahead
        new, c_new = ahead - step * gradient, c_ahead - step * error.mean() * 4
        momentum = k / (k + 3)
        ahead, c_ahead = new + momentum * (new - w), c_new + momentum * (c_new - c)
        w, c = new, c_new
    return w, float(c)


def scorer(docs: DataFrame, model: Model):
    """A function that gives a text column's toxicity from 0 to 1; every n-gram of the whole text is looked at.

    Each feature that a text holds counts once. NULL and empty texts get the score of a text without features.
    """
    table, intercept = docs.sparkSession.sparkContext.broadcast(model.table()), model.intercept

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, out = table.value, []
        for text in texts:
            found = _buckets(text)
            found = np.unique(found[weights[found] != 0])
            out.append(1 / (1 + np.exp(-np.clip(intercept + float(weights[found].sum()), -500, 500))))
        return pd.Series(out, dtype="float64")

    def of(text: Column) -> Column:
        return score(text)

    return of


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``labels`` scores below ``threshold``.

    NULL, empty and very long texts have a score like others; repeated rows stay or go together. Without labels of both kinds all rows have
    one score. An empty table gives an empty one.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    return docs.where(scorer(docs, model)(F.col(text_col)) < threshold)
