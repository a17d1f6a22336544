"""Byte-level BPE by a table of ranks: texts are pre-tokenised in overlapping chunks, stitched, and encoded piece by piece."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.llm.common import ship_package, stored, unused

#: Fixed value: the pattern that cuts a text to pre-tokens; merges never cross their borders.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space, as the pattern's ``\\s``.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No pre-token has white space after another character, so white space after one starts a pre-token wherever scanning began.
#: Runs up to there, with the space before them, are what a worker remembers.
RUN = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
FIRM = f"(?<=[^{WHITE}])[{WHITE}]"
#: Characters of a chunk, and those that it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: Characters after a border that the pattern may look at to place it.
AHEAD = 3
#: Encoded runs and pre-tokens that a Python worker remembers before it starts anew.
REMEMBERED = 400_000


class Remembered(dict):
    """A dict that fills itself."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Ranks:
    """A vocabulary: the rank of each token's bytes is its id and its turn to be merged. ``source`` is the text of a rank file."""

    def __init__(self, source: str):
        self.rank = {base64.b64decode(token): int(rank) for token, rank in map(str.split, filter(str.strip, source.splitlines()))}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.never = max(self.token, default=0) + 1
        self.pre_tokens = regex.compile(PATTERN)
        self.runs = re.compile(RUN).findall
        self.firm = re.compile(FIRM).search
        self.word_ids = Remembered(lambda word: array("I", self.merged(word.encode("utf-8", "surrogatepass"))).tobytes())
        self.run_ids = Remembered(lambda run: b"".join([self.word_ids[w] for w in self.pre_tokens.findall(run)]))

    def merged(self, word: bytes) -> list[int]:
        """The ids of a pre-token: the adjacent pair of least rank is merged, the leftmost of equals, until none has a rank."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        if len(word) > 100:
            return self._merged_long(word)
        rank, never = self.rank.get, self.never
        starts = list(range(len(word) + 1))
        turns = [rank(word[i:i + 2], never) for i in range(len(word) - 1)]
        while turns:
            least = min(turns)
            if least == never:
                break
            i = turns.index(least)
            del turns[i], starts[i + 1]
            if i < len(turns):
                turns[i] = rank(word[starts[i]:starts[i + 2]], never)
            if i:
                turns[i - 1] = rank(word[starts[i - 1]:starts[i + 1]], never)
        return [self.rank[word[a:b]] for a, b in zip(starts, starts[1:])]

    def _merged_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs, for words where a scan for each merge would take squared time."""
        n, rank = len(word), self.rank.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                end = after[after[i]]
                turn = rank(word[i:end])
                if turn is not None:
                    heapq.heappush(heap, (turn, i, end))

        for i in range(n - 1):
            offer(i)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            alive[after[i]] = 0
            after[i] = end
            if end < n:
                before[end] = i
            offer(before[i])
            offer(i)
        found, i = [], 0
        while i < n:
            found.append(self.rank[word[i:after[i]]])
            i = after[i]
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a piece that starts and ends at borders of pre-tokens, as little-endian unsigned 32-bit integers."""
        if len(self.run_ids) > REMEMBERED:
            self.run_ids.clear()
        if len(self.word_ids) > REMEMBERED:
            self.word_ids.clear()
        return b"".join(map(self.run_ids.__getitem__, self.runs(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[str, Ranks] = {}


def _ranks(source: tuple) -> Ranks:
    """One vocabulary for each broadcast rank file and Python worker."""
    file, digest = source
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Ranks(file.value)
    return _LOADED[digest]


def load(spark: SparkSession, path: str) -> tuple:
    """The rank file at ``path``, read by the driver and sent to the executors, and its digest; its size is that of a vocabulary."""
    ship_package(spark)
    with open(path, encoding="ascii") as file:
        text = file.read()
    return spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()


def borders(text: str, chunk: int, overlap: int, ranks: Ranks) -> tuple[list[int], list[int], bool]:
    """Where pre-tokens start when scanning begins at the start of ``text``: (in its first ``overlap`` characters, in those after the
    first ``chunk`` relative to them, whether scanning has met a border that every scan has before these).

    The second list leaves out borders after white space and those whose place might change with what follows the text.
    """
    head, tail = [], []
    for found in ranks.pre_tokens.finditer(text):
        at = found.start()
        if at < overlap:
            head.append(at)
        if chunk <= at <= len(text) - AHEAD and not text[at - 1].isspace():
            tail.append(at - chunk)
    firm = ranks.firm(text)
    return head, tail, firm is not None and firm.start() < chunk


def _cut(long: DataFrame, key: str, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n, chunk): overlapping chunks of texts, each with the first characters of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                for first in range(0, len(text), 64 * chunk):
                    starts = range(first, min(len(text), first + 64 * chunk), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(starts)), pa.array([s // chunk for s in starts]), pa.array([text[s:s + chunk + overlap] for s in starts])],
                        names=["key", "n", "chunk"],
                    )

    return long.select(F.col(key).alias("key"), text_col).mapInArrow(run, "key long, n long, chunk string")


def _scan(chunks: DataFrame, source, chunk: int, overlap: int) -> DataFrame:
    """Chunks with the borders of their pre-tokens near both ends; each is scanned by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(source)
        for batch in batches:
            found = [borders(value.as_py(), chunk, overlap, ranks) for value in batch.column(2)]
            heads, tails, firm = zip(*found) if found else ((), (), ())
            more = [pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32())), pa.array(firm, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "head", "tail", "firm"])

    return chunks.mapInArrow(run, "key long, n long, chunk string, head array<int>, tail array<int>, firm boolean")


def stitch(scanned: DataFrame, chunk: int) -> DataFrame:
    """(key, n, group, members, start, length): the part of each chunk that belongs to a piece of the text.

    Two scans that share a border go on alike. So a piece starts in a chunk at the first border that the scan of the chunk before also has,
    provided that this one was right by then: it has met a border that every scan has, or began right itself. Chunks where no such
    border lies in the overlap (a pre-token longer than it) join the piece before. Nothing but numbers goes through the window, which
    holds the chunks of one text.
    """
    text = Window.partitionBy("key").orderBy("n")
    so_far = text.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("n") == 0
    met = scanned.select("key", "n", "firm", F.array_min(F.array_intersect(F.lag("tail").over(text), "head")).alias("meets"))
    placed = met.select(
        "key", "n", "meets",
        F.max(F.when(~first & F.col("meets").isNull(), F.col("n"))).over(so_far).alias("apart"),
        F.max(F.when(first | F.col("firm"), F.col("n"))).over(text.rowsBetween(Window.unboundedPreceding, -1)).alias("right"),
    )
    starts = first | F.col("meets").isNotNull() & (F.coalesce("apart", F.lit(0)) <= F.col("right"))
    begun = placed.select("key", "n", F.when(first, 0).when(starts, F.col("meets")).alias("begin"))
    grouped = begun.select(
        "key", "n", F.coalesce("begin", F.lit(0)).alias("start"), F.max(F.when(F.col("begin").isNotNull(), F.col("n"))).over(so_far).alias("group"),
        F.when(F.lead("n").over(text).isNull(), 2 * chunk).otherwise(chunk + F.coalesce(F.lead("begin").over(text), F.lit(0))).alias("until"),
    )
    members = F.count(F.lit(1)).over(Window.partitionBy("key", "group"))
    return grouped.select("key", "n", "group", members.alias("members"), "start", (F.col("until") - F.col("start")).cast("int").alias("length"))


def _encoded(rows: DataFrame, source, text_col: str, ids_col: str) -> DataFrame:
    """``rows`` with ``ids_col`` in place of the pieces in ``text_col``; NULL is an empty text."""
    schema = rows.drop(text_col).schema.add(ids_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(source)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            ids = pa.array([ranks.encode(value.as_py() or "") for value in batch.column(at)], pa.binary())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), ids], names=[*(batch.schema.names[i] for i in rest), ids_col])

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids_col`` (binary) in place of ``text_col``: the ids of each whole text, little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file (base64 of a token's bytes and its rank on each line). Names of special tokens in a
    text are ordinary text. NULL and empty texts have no ids. Rows are kept as they are, repeated ones and NULL ids of documents
    too; an empty table gives an empty one.

    A text of at most ``chunk`` characters is one piece and stays in its task. Longer ones are cut to chunks that overlap
    by ``overlap`` characters and are dealt out, so that one text of any length is scanned and encoded by many tasks; see ``stitch``.
    The result does not depend on either size.
    """
    if not AHEAD < overlap <= chunk:
        raise ValueError("the overlap must be at most a chunk and hold what the pattern looks ahead")
    source = load(docs.sparkSession, ranks)
    key, ids = unused(docs, "_row", "_ids")
    if ids_col != text_col:
        docs = docs.drop(ids_col)
    is_long = F.coalesce(F.length(text_col) > chunk, F.lit(False))
    whole = _encoded(docs.where(~is_long), source, text_col, ids)
    # numbered once stored, so that a row has the same number whenever a task is repeated
    long = stored(docs.where(is_long).withColumn(key, F.monotonically_increasing_id()), "byte-bpe-texts")
    scanned = stored(_scan(_cut(long, key, text_col, chunk, overlap).repartition("key", "n"), source, chunk, overlap), "byte-bpe-chunks")
    parts = stitch(scanned.select("key", "n", "head", "tail", "firm"), chunk)

    def texts(of: Column) -> DataFrame:
        part = F.substring("chunk", F.col("start") + 1, F.col("length"))
        return scanned.select("key", "n", "chunk").join(parts.where(of), ["key", "n"]).select("key", "group", "n", part.alias("piece"))

    single = texts(F.col("members") == 1).drop("n")
    several = texts(F.col("members") > 1).groupBy("key", "group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("piece")
    )
    pieces = _encoded(single.unionByName(several), source, "piece", "ids")
    joined = pieces.groupBy("key").agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY group)").alias(ids))
    cut = long.drop(text_col).join(joined.withColumnRenamed("key", key), key).select(*whole.columns)
    return whole.unionByName(cut).withColumnRenamed(ids, ids_col)


def decode(rows: DataFrame, ranks: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with ``bytes_col`` (binary): the bytes of the ids' tokens, one after the other; NULL ids give NULL, no ids no bytes."""
    source = load(rows.sparkSession, ranks)
    schema = rows.drop(bytes_col).schema.add(bytes_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _ranks(source)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = (x.as_py() for x in part.column(part.schema.get_field_index(ids_col)))
                found = pa.array([None if v is None else table.decode(v) for v in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, bytes_col])

    return rows.drop(bytes_col).mapInArrow(run, schema)
