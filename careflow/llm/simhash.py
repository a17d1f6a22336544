"""SimHash near duplicates: fingerprints of word shingles, linked by a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import discard, merge_roots, ship_package, sorted_pieces, stored, unused, words
from careflow.llm.components import connected_components

SEED = 42
#: Fingerprints of one task's trie, and of one side of a pair of long runs.
PIECE, CHUNK = 1 << 15, 1 << 12
#: Node pairs that a task descends at once, and pairs of leaves that it compares directly below a node pair.
FRONTIER, DIRECT = 1 << 16, 16


def _fingerprint(text: str | None, width: int) -> int:
    found = words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(found) - width + 1)
    digest, spans = xxhash.xxh64_intdigest, zip(starts[:n].tolist(), ends[min(width, len(found)) - 1:].tolist())
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, n, 1 << 14):
        block = np.unpackbits(hashes[part:part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += block.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, width: int = 4) -> Column:
    """64-bit SimHash of the ``width``-word shingles of a whole text, repeats included, as a signed long.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shingle's hash is the XXH64 (seed 42) of its words
    joined by a space. A bit is set where more than half the hashes have it. A text of fewer words is one
    shingle; NULL, empty and blank texts have the fingerprint 0.
    """

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t, width) for t in texts], dtype="int64")

    return simhash(text)


def trie_links(values: np.ndarray, roots: np.ndarray, pairs: np.ndarray, level: int, budget: int) -> np.ndarray:
    """Join sorted uint64 ``values`` by descending pairs of nodes of their binary trie together.

    A node is a range of values that share their first bits. ``pairs`` has rows (a_from, a_to, b_from, b_to) of
    nodes that share the first ``level`` bits; equal ranges are a join of a node with itself. Going down a bit, a pair
    gives the pairs of its children, with one more differing bit where the children differ, and a pair is left as soon as its
    differing bits exceed ``budget``. So is a pair whose values all belong to one set by now: what it could link is
    linked. Returns ``roots``, the set of each value, with the sets of linked values joined.
    """
    bits = ((values[None, :] >> np.arange(63, -1, -1, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.int32)
    ones = np.concatenate([np.zeros((64, 1), np.int32), np.cumsum(bits, axis=1, dtype=np.int32)], axis=1)
    del bits

    def changes() -> np.ndarray:
        return np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])

    change = changes()
    stack = [(level, np.column_stack([pairs, np.zeros(len(pairs), np.int64)]))]
    while stack:
        level, p = stack.pop()
        a0, a1, b0, b1 = p[:, 0], p[:, 1], p[:, 2], p[:, 3]
        joined = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (roots[a0] == roots[b0])
        p = p[~joined]
        if len(p) > FRONTIER:
            stack += [(level, p[i:i + FRONTIER]) for i in range(0, len(p), FRONTIER)]
            continue
        small = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]) <= DIRECT
        if small.any():
            q = p[small]
            across = q[:, 3] - q[:, 2]
            each = (q[:, 1] - q[:, 0]) * across
            at = np.repeat(np.arange(len(q)), each)
            within = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            i, j = q[at, 0] + within // across[at], q[at, 2] + within % across[at]
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                roots = merge_roots(roots, i[near], j[near])
                change = changes()
        p = p[~small]
        if not len(p):
            continue
        a0, a1, b0, b1, differing = p.T
        am, bm = a1 - (ones[level][a1] - ones[level][a0]), b1 - (ones[level][b1] - ones[level][b0])
        itself = a0 == b0
        down = [
            np.column_stack([a0, am, b0, bm, differing]),
            np.column_stack([am, a1, bm, b1, differing]),
            np.column_stack([a0, am, bm, b1, differing + 1]),
            np.column_stack([am, a1, b0, bm, differing + 1])[~itself],
        ]
        p = np.concatenate(down)
        p = p[(p[:, 1] > p[:, 0]) & (p[:, 3] > p[:, 2]) & (p[:, 4] <= budget)]
        stack.append((level + 1, p))
    return roots


def _prefix_bits(budget: int) -> list[int]:
    """Cut 64 bits to ``budget`` + 1 blocks: two values within the budget agree in one of them."""
    blocks = budget + 1
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def near_links(values: DataFrame, budget: int = 4) -> DataFrame:
    """Links (a, b: long) that join distinct 64-bit ``values`` (value: long) within ``budget`` bits to their components.

    A binary trie of all values is walked once for each of ``budget`` + 1 rotations of the bits: in one rotation the first block
    of two near values agrees, so that the walk may start below the nodes of that block, each its own small trie.
    The sorted rotated values are dealt out by range, so a crowded node is spread over tasks. What it has in
    several pieces is joined piece by piece in a second step, but for pieces that the first step has already linked to each other.
    Returns spanning links of what a task joined, never all pairs.
    """
    width = _prefix_bits(budget)
    starts = [sum(width[:i]) for i in range(len(width))]
    turned = [
        F.struct(
            F.lit(i).alias("turn"),
            (F.shiftleft("value", s).bitwiseOR(F.shiftrightunsigned("value", 64 - s)) if s else F.col("value")).alias("turned"),
        )
        for i, s in enumerate(starts)
    ]
    lists = values.select(F.explode(F.array(*turned)).alias("t")).select("t.turn", "t.turned")
    lists = lists.repartitionByRange("turn", "turned").sortWithinPartitions("turn", "turned")
    shifts = np.array([64 - w for w in width], dtype=np.uint64)

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {"turn": batch.column(0).to_numpy(), "turned": batch.column(1).to_numpy().view(np.uint64)}

    def node(part: dict[str, np.ndarray]) -> np.ndarray:
        return (part["turned"] >> shifts[part["turn"]]).astype(np.int64) * len(width) + part["turn"]

    def back(turned: np.ndarray, turn: np.ndarray) -> np.ndarray:
        s = np.array(starts, dtype=np.uint64)[turn]
        return np.where(s > 0, (turned >> s) | (turned << ((np.uint64(64) - s) & np.uint64(63))), turned).view(np.int64)

    def rows(kind, turn, node_id, chunk, a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(turn, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (node_id, chunk, a, b))],
            names=["kind", "turn", "node", "chunk", "a", "b"],
        )

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds, is_open in sorted_pieces(batches, arrays, node, PIECE):
            turned, turn, keys = part["turned"], part["turn"], node(part)
            pairs = np.column_stack([bounds[:-1], bounds[1:], bounds[:-1], bounds[1:]])
            roots = trie_links(turned, np.arange(len(turned)), pairs, min(width), budget)
            own = back(turned, turn)
            linked = np.flatnonzero(roots != np.arange(len(turned)))
            zero = np.zeros(len(linked), np.int64)
            yield rows(0, zero, zero, zero, own[linked], own[roots[linked]])
            for i in np.flatnonzero(is_open):
                at = np.arange(bounds[i], bounds[i + 1])
                chunk = turned[at - (at - bounds[i]) % CHUNK].view(np.int64)  # named by its first value
                yield rows(1, turn[at], keys[at], chunk, own[at], turned[at].view(np.int64))

    found = stored(lists.mapInArrow(within, "kind int, turn int, node long, chunk long, a long, b long"), "trie-nodes")
    links = found.where("kind = 0").select("a", "b").distinct()
    sets = stored(connected_components(links), "trie-sets")
    chunks = stored(
        found.where("kind = 1").select("turn", "node", "chunk", "a", F.col("b").alias("turned"))
        .join(sets.withColumnRenamed("node", "a"), "a", "left")
        .groupBy("node", "turn", "chunk")
        .agg(
            F.min(F.coalesce("component", "a")).alias("low"), F.max(F.coalesce("component", "a")).alias("high"),
            F.array_sort(F.collect_list("turned")).alias("turned"),
        ),
        "trie-chunks",
    )
    left, right = (chunks.select("node", *(F.col(c).alias(f"{c}_{side}") for c in ("turn", "chunk", "low", "high", "turned"))) for side in "ab")
    pairs = left.join(right, "node").where(
        "chunk_a < chunk_b AND NOT (low_a = high_a AND low_b = high_b AND low_a = low_b)"
    ).select(F.col("turn_a").alias("turn"), "turned_a", "turned_b")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn, a, b in zip(*(c.to_pylist() if k == 0 else c for k, c in enumerate(batch.columns))):
                both = np.concatenate([np.array(x.values.to_numpy(), dtype=np.int64).view(np.uint64) for x in (a, b)])
                n = len(a.values)
                # ranges of one sorted list do not overlap, so the two sorted chunks are one sorted list in either order
                roots = trie_links(both, np.arange(len(both)), np.array([[0, n, n, len(both)]]), min(width), budget)
                linked = np.flatnonzero(roots != np.arange(len(both)))
                own = back(both, np.full(len(both), turn))
                yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[roots[linked]])], names=["a", "b"])

    more = pairs.mapInArrow(across, "a long, b long")
    return sets.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, width: int = 4) -> DataFrame:
    """One row per row of ``docs``: (id, text_hash, fingerprint, class_id, component_id).

    Texts whose fingerprints differ in at most ``budget`` bits are linked; ``class_id`` names the component of linked
    fingerprints and ``component_id`` is its smallest id. Equal fingerprints collapse before the join. Repeated rows
    stay; an id of NULL is never a component's id unless all ids of the component are NULL. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    marked = stored(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), fingerprint(F.col(text_col), width).alias("fingerprint")),
        "fingerprints",
    )
    values = stored(marked.groupBy(F.col("fingerprint").alias("value")).agg(F.min("id").alias("first_id")), "fingerprint-values")
    sets = connected_components(near_links(values.select("value"), budget))
    classes = stored(
        values.join(sets.select(F.col("node").alias("value"), "component"), "value", "left")
        .select("value", "first_id", F.coalesce("component", "value").alias("class_id")),
        "fingerprint-classes",
    )
    first = classes.groupBy("class_id").agg(F.min("first_id").alias("component_id"))
    named = stored(classes.select("value", "class_id").join(first, "class_id"), "fingerprint-components")
    discard(values)
    discard(classes)
    return marked.join(named.withColumnRenamed("value", "fingerprint"), "fingerprint", "left").select(
        "id", "text_hash", "fingerprint", "class_id", "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, width: int = 4) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; of repeated rows with that id, one.

    NULL, empty and blank texts share the fingerprint 0. A NULL id is kept only where all ids of a component are NULL; of different texts under
    the smallest id, that of least hash. An empty table gives an empty one.
    """
    marked = near_duplicates(docs, id_col, text_col, budget, width)
    first = marked.where("id <=> component_id").groupBy("class_id").agg(
        F.min(F.struct("id", "text_hash")).alias("kept"), F.count("*").alias("rows")
    )
    first = stored(first.select("kept.*", "rows"), "kept")
    id_of, hash_of = unused(docs, "kept_id", "kept_hash")
    key = [F.col(id_of).eqNullSafe(F.col(id_col)), F.col(hash_of) == F.xxhash64(text_col)]

    def of(rows: str) -> DataFrame:
        return docs.join(first.where(rows).select(F.col("id").alias(id_of), F.col("text_hash").alias(hash_of)), key, "left_semi")

    return of("rows = 1").union(of("rows > 1").dropDuplicates([id_col, text_col]))
