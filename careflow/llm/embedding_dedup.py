"""Near duplicates among embeddings: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import discard, merge_roots, ship_package, sorted_pieces, stored
from careflow.llm.components import connected_components

SEED = 20240229
#: Share of the pairs at the threshold itself that the tables may miss; closer pairs are missed less often.
MISSED = 5e-4
#: Vectors aimed at in a bucket of vectors without near ones.
FILL = 16
#: Signs that stand for a vector until a near one is likely, and share of the pairs at the threshold that these signs may miss.
SKETCH, UNLIKELY = 128, 1e-6
#: Rows that a task compares at a time, and rows of one side of a pair of pieces of a long bucket.
PIECE, CHUNK = 1 << 14, 1 << 9
FOUND = "kind int, a long, b long, n long, dim int, label string, turn int, bucket long, ids binary, copies binary, vectors binary"


def table_shape(n: int, threshold: float) -> tuple[int, int]:
    """(signs per table, tables): signs grow with the logarithm of ``n`` so that buckets stay small, and tables with them,
    so that a pair of cosine ``threshold`` meets in one of them with probability 1 - ``MISSED``."""
    signs = max(8, math.ceil(math.log2(max(1, n) / FILL)))
    same = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(MISSED) / math.log(1 - same))


def most_apart(n: int, threshold: float) -> int:
    """Of ``n`` signs, the number that a pair of cosine ``threshold`` exceeds by differing with probability ``UNLIKELY`` at most."""
    apart, rest = math.acos(threshold) / math.pi, 1.0
    for k in range(n + 1):
        rest -= math.comb(n, k) * apart**k * (1 - apart) ** (n - k)
        if rest <= UNLIKELY:
            return k
    return n


def usable(vector: str, label: str, vec_id: str) -> Column:
    """Whether a row can have links: an id, a label and a finite vector that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _signs(vectors: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """The bucket of each scaled vector in each table: the same in every task."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], signs * tables))
    bits = np.stack([v @ planes > 0 for v in vectors]) if len(vectors) else np.zeros((0, signs * tables), bool)
    return bits.reshape(len(vectors), tables, signs) @ (1 << np.arange(signs, dtype=np.int64))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, which changes no cosine and keeps squares in range."""
    return vectors / np.exp2(np.floor(np.log2(np.abs(vectors).max(axis=1))))[:, None]


def _near(unit: np.ndarray, signs: np.ndarray, turn: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float):
    """Of the pairs (i, j), those of at least ``threshold`` that share no bucket in an earlier table, so that each is counted once."""
    cosine = np.einsum("ij,ij->i", unit[i], unit[j])
    i, j = i[cosine >= threshold], j[cosine >= threshold]
    first = (signs[i] == signs[j]).argmax(axis=1) == turn[i] if len(i) else np.zeros(0, bool)
    return i[first], j[first]


def _likely(sketch: np.ndarray, turn: np.ndarray, i: np.ndarray, j: np.ndarray, most: int):
    """Of the pairs (i, j), those whose sketches (buckets in the first tables) differ in ``most`` signs or fewer and have no earlier table in common."""
    apart = sketch[i] ^ sketch[j]
    near = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= most
    i, j, apart = i[near], j[near], apart[near]
    first = ~((apart == 0) & (np.arange(sketch.shape[1]) < turn[i][:, None])).any(axis=1)
    return i[first], j[first]


def _pairs_of_runs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within each run, a bounded number at a time."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    many = 1 << 15
    for s, n in zip(starts[sizes > 128].tolist(), sizes[sizes > 128].tolist()):
        rows = max(1, many // n)
        for r in range(s, s + n, rows):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(r, min(r + rows, s + n)), np.arange(s, s + n), indexing="ij"))
            yield i[i < j], j[i < j]
    small = (sizes > 1) & (sizes <= 128)
    starts, sizes = starts[small], sizes[small]
    total = np.cumsum(sizes**2)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + many, "right")))
        each = sizes[at:to] ** 2
        run = np.repeat(np.arange(at, to), each)
        within = np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
        i, j = starts[run] + within // sizes[run], starts[run] + within % sizes[run]
        yield i[i < j], j[i < j]
        at = to


def _batch(kind: int, a=(), b=None, n=None, chunk: dict | None = None) -> pa.RecordBatch:
    """Rows of ``FOUND``."""
    size = 1 if chunk else len(a)
    chunk = chunk or {}
    columns = {"kind": np.full(size, kind, np.int32), "a": a if size and not chunk else None, "b": b, "n": n} | chunk
    schema = pa.schema(
        [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("label", pa.string()),
         ("turn", pa.int32()), ("bucket", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())]
    )
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, f.type) if columns.get(f.name) is None else pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )


def _results(ids: np.ndarray, copies: np.ndarray, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Spanning links and the number of vectors that each class is linked with, for blocks of linked rows (i, j), which are added up one at a time."""
    node, at = np.unique(ids, return_inverse=True)
    degree, roots = np.zeros(len(node)), np.arange(len(node))
    for i, j in found:
        if len(i):
            degree += np.bincount(at[i], copies[j], len(node)) + np.bincount(at[j], copies[i], len(node))
            roots = merge_roots(roots, at[i], at[j])
    if not degree.any():
        return
    linked, counted = np.flatnonzero(roots != np.arange(len(node))), np.flatnonzero(degree)
    yield _batch(0, node[linked], node[roots[linked]])
    yield _batch(1, node[counted], n=degree[counted].astype(np.int64))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """One row per row of ``vectors``: (vec_id, n_links, component_id).

    Vectors of equal label and dimension whose cosine is at least ``threshold`` are linked. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable. Equal vectors are one class and compared once. Classes meet in the buckets of
    several tables of signs; the rows of all buckets are sorted and dealt out by range, first with ``SKETCH`` signs each in place of the vector. Vectors
    follow only to the buckets where a pair is likely near and first meets, and into all of a bucket that is cut; what a long bucket has in several pieces is compared
    piece by piece. A link is counted in the first table where its classes meet. Only spanning links and counts per class leave a task.

    Rows whose label or vector is NULL, whose vector is zero or holds NULL or a number that is not finite, have no links and are their own
    component; so do rows whose id is NULL, whose component is NULL. An empty table gives no rows.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label")
    ).withColumn("usable", usable("vector", "label", "vec_id"))
    classes = stored(
        rows.where("usable").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )
    signs, tables = table_shape(classes.count(), threshold)
    first = max(1, min(tables, SKETCH // signs))  # tables whose buckets are the sketch
    most = most_apart(first * signs, threshold)
    weights = 1 << np.arange(signs, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for start in range(0, len(at), 1024):
                    own = at[start:start + 1024]
                    buckets = _signs(_scaled(flat[(ends[own] - dim)[:, None] + np.arange(dim)]), signs, tables)
                    bits = (buckets[:, :first, None] & weights > 0).reshape(len(own), -1)
                    sketch = [r.tobytes() for r in np.packbits(bits, axis=1)]
                    where, again = pa.array(np.repeat(own, tables)), pa.array(np.repeat(np.arange(len(own)), tables))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(where), dim, np.int32)), batch.column(1).take(where), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))),
                            pa.array(buckets.ravel()), batch.column(0).take(where), pa.array(sketch, pa.binary()).take(again),
                        ],
                        names=["dim", "label", "turn", "bucket", "class_id", "sketch"],
                    )

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}

    def key(part: dict[str, np.ndarray]) -> np.ndarray:
        _, label = np.unique(part["label"].astype(str), return_inverse=True)
        return np.rec.fromarrays([part["dim"], label, part["turn"], part["bucket"]])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds, is_open in sorted_pieces(batches, arrays, key, PIECE):
            packed = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint8).reshape(len(part["turn"]), -1)
            sketch = np.unpackbits(packed, axis=1, count=first * signs).reshape(-1, first, signs) @ weights
            wanted = np.repeat(is_open, np.diff(bounds))  # the rest of a long bucket stands elsewhere
            for i, j in _pairs_of_runs(bounds):
                for side in _likely(sketch, part["turn"], i, j, most):
                    wanted[side] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[c][wanted]) for c in ("turn", "bucket", "class_id")], schema=pa.schema([("turn", pa.int32()), ("bucket", pa.int64()), ("class_id", pa.int64())])
            )

    order = ["dim", "label", "turn", "bucket", "class_id"]
    signed = classes.select("class_id", "label", "vector").mapInArrow(sign, "dim int, label string, turn int, bucket long, class_id long, sketch binary")
    wanted = stored(
        signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(likely, "turn int, bucket long, class_id long"), "likely-near"
    )
    dealt = wanted.join(classes.select("class_id", "label", "vector", "copies"), "class_id").select(
        F.size("vector").alias("dim"), "label", "turn", "bucket", "class_id", "copies", "vector"
    ).repartitionByRange(*order).sortWithinPartitions(*order)

    def matrix(column: pa.ListArray | list, at: np.ndarray, dim: int) -> np.ndarray:
        return _scaled(np.stack([column[k] for k in at]).astype(np.float64).reshape(-1, dim))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds, is_open in sorted_pieces(batches, arrays, key, PIECE):
            runs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for dim in np.unique(part["dim"]):
                at = np.flatnonzero(part["dim"] == dim)  # adjacent rows, sorted by dimension first
                vectors = matrix(part["vector"], at, dim)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(runs[at])) + 1, [len(at)]])
                own, unit, turn = _signs(vectors, signs, tables), _unit(vectors), part["turn"][at]
                found = (_near(unit, own, turn, i, j, threshold) for i, j in _pairs_of_runs(edges))
                yield from _results(part["class_id"][at], part["copies"][at], found)
            for r in np.flatnonzero(is_open):
                for s in range(bounds[r], bounds[r + 1], CHUNK):
                    to = min(s + CHUNK, bounds[r + 1])
                    yield _batch(2, chunk={
                        **{c: [part[c][s]] for c in ("dim", "label", "turn", "bucket")}, "a": [part["class_id"][s]], "b": [part["class_id"][bounds[r]]],
                        "ids": [part["class_id"][s:to].tobytes()], "copies": [part["copies"][s:to].tobytes()],
                        "vectors": [matrix(part["vector"], np.arange(s, to), part["dim"][s]).tobytes()],
                    })

    found = stored(dealt.mapInArrow(compare, FOUND), "found")
    bucket = ["dim", "label", "turn", "bucket"]
    data = ["a", "b", "ids", "copies", "vectors"]
    left, right = (found.where("kind = 2").select(*bucket, *(F.col(c).alias(f"{c}_{side}") for c in data)) for side in "lr")
    pairs = left.join(right, bucket).where("a_l < a_r AND b_l <> b_r")  # chunks of one piece have met
    pairs = pairs.select("dim", "turn", *(f"{c}_{s}" for s in "lr" for c in data[2:]))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, turn, *sides = (c[row].as_py() for c in batch.columns)
                ids, copies = (np.frombuffer(sides[k] + sides[k + 3], dtype=np.int64) for k in range(2))
                vectors = np.frombuffer(sides[2] + sides[5], dtype=np.float64).reshape(-1, dim)
                unit, own = _unit(vectors), _signs(vectors, signs, tables)
                n = len(sides[0]) // 8
                i, j = np.nonzero(unit[:n] @ unit[n:].T >= threshold)
                yield from _results(ids, copies, [_near(unit, own, np.full(len(ids), turn), i, j + n, threshold)])

    discard(wanted)
    links = stored(found.where("kind < 2").select("kind", "a", "b", "n").union(pairs.mapInArrow(across, FOUND).select("kind", "a", "b", "n")), "links")
    discard(found)
    degree = links.where("kind = 1").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("linked"))
    sets = connected_components(links.where("kind = 0").select("a", "b"))
    named = (
        classes.join(degree, "class_id", "left").join(sets.withColumnRenamed("node", "class_id"), "class_id", "left")
        .withColumn("component", F.coalesce("component", "class_id"))
    )
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(first, "component").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), "component_id",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
    )
    named = stored(named, "named-classes")
    discard(links)
    discard(classes)
    same = F.col("usable") & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))
    return rows.join(named, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
