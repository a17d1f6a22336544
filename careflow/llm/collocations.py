"""Phrases whose words stand together more often than chance: candidates are counted level by level by broadcast double-array tries."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import ship_package, stored

#: Bytes that end a piece of text; no phrase goes across one. Words are separated by space and tab.
ENDS = b".,;:!?\n\x0b\x0c\r"
MARK = b"\xff"  # no byte of UTF-8
TO_MARKS = bytes.maketrans(ENDS, MARK * len(ENDS))
#: Words of a block of text; bytes that are cut to words at once.
BLOCK, SLICE = 1 << 21, 1 << 22
#: Number of the words that make one trie's leaves, and so the bound of a broadcast: a level with more leaves takes several tries.
LEAVES = 1 << 18
#: A word's number is a string of digits of so many bits, the alphabet of the tries.
DIGIT_BITS = 6
DIGITS = 1 << DIGIT_BITS
#: Neighbouring accepting states whose sums are added up together.
RANGE_BITS = 16


class Block:
    """Texts of one language as numbers of their distinct words; -1 stands between pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = {MARK: -1}
        self.numbers = array("i")

    def add(self, raw: bytes) -> None:
        words = raw.translate(TO_MARKS).replace(MARK, b" \xff ").split()
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number) - 1
        self.numbers.extend(map(number.__getitem__, words))

    def cut(self, lang: str, first: int, context: int) -> dict:
        """The row of the ``first`` words, which has ``context`` words more to look at; all others start a new block."""
        numbers = np.frombuffer(self.numbers, np.int32)
        starts = min(first, len(numbers))
        words = list(self.number)[1:]
        here = numbers[:starts]
        counts = np.bincount(here[here >= 0], minlength=len(words))
        row = {
            "lang": lang, "words": [w.decode("utf-8", "surrogatepass") for w in words], "counts": counts.tolist(), "total": int(counts.sum()),
            "numbers": numbers[:starts + context].tobytes(), "starts": starts,
        }
        rest = [MARK if i < 0 else words[i] for i in numbers[starts:].tolist()]
        self.number, self.numbers = {MARK: -1}, array("i")
        for w in rest:
            self.numbers.append(self.number.setdefault(w, len(self.number) - 1))
        return row


BLOCK_SCHEMA = "lang string, words array<string>, counts array<long>, total long, numbers binary, starts int"
BLOCK_TYPE = pa.schema([
    ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("total", pa.int64()), ("numbers", pa.binary()), ("starts", pa.int32()),
])


def _slices(raw: bytes) -> Iterator[bytes]:
    """Parts of a text that end between words."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and raw[end:end + 1] not in b" \t":
            space = raw.find(b" ", end)
            end = len(raw) if space < 0 else space
        yield raw[at:end]
        at = end


def blocks(docs: DataFrame, lang_col: str, text_col: str, longest: int, size: int = BLOCK) -> DataFrame:
    """Texts of a task by language in blocks of ``size`` words, with the counts of each block's distinct words."""
    context = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Block] = {}

        def emit(lang: str, whole: bool) -> pa.RecordBatch:
            block = held[lang]
            return pa.RecordBatch.from_pylist([block.cut(lang, len(block.numbers) if whole else size, context)], BLOCK_TYPE)

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if not text:
                    continue
                block = held.setdefault(lang, Block())
                for raw in _slices(text.encode("utf-8", "surrogatepass").lower()):
                    block.add(raw)
                    while len(block.numbers) >= size + context:
                        yield emit(lang, False)
                block.numbers.append(-1)
                if sum(len(b.numbers) for b in held.values()) > 2 * size and len(held) > 1:
                    # many languages: none is full, all together are
                    for one in list(held):
                        yield emit(one, True)
                        del held[one]
        for lang in held:
            yield emit(lang, True)

    return docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id``: numbers from 0 on without gaps, by the place of a row in its partition and the rows of those before."""
    placed = stored(words.withColumn("_place", F.monotonically_increasing_id()), "collocation-words")
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return placed.withColumn("_part", part).join(before, "_part").withColumn("id", (F.col("_before") + within).cast("int")).drop("_part", "_place", "_before")


def _resolved(rows: DataFrame, share: pa.Table, last: bool) -> DataFrame:
    """Blocks with the words of ``share`` by their numbers in the whole vocabulary, kept as -2 - id while others are still to be resolved.

    The ``last`` share gives (ids, starts): the numbers, and -1 for all other words and between pieces, once for several in a row.
    """
    sent = rows.sparkSession.sparkContext.broadcast(share.to_pydict())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers_of: dict[str, dict[str, int]] = {}
        for lang, word, n in zip(*(sent.value[c] for c in ("lang", "word", "id"))):
            numbers_of.setdefault(lang, {})[word] = n
        for batch in batches:
            for lang, words, numbers, starts in zip(*(batch.column(c) for c in ("lang", "words", "numbers", "starts"))):
                of, numbers = numbers_of.get(lang.as_py(), {}), np.frombuffer(numbers.as_py(), np.int32)
                found = np.array([-2 - of[w] if w in of else i for i, w in enumerate(words.as_py())] + [-1], np.int32)
                numbers = np.where(numbers >= 0, found[np.maximum(numbers, -1)], numbers)
                if last:
                    numbers = np.where(numbers < -1, -2 - numbers, np.int32(-1))
                    keep = (numbers >= 0) | np.concatenate([[True], numbers[:-1] >= 0])
                    held = [pa.array([numbers[keep].tobytes()], pa.binary()), pa.array([int(keep[:starts.as_py()].sum())], pa.int32())]
                    yield pa.RecordBatch.from_arrays(held, names=["ids", "starts"])
                else:
                    held = [pa.array([lang.as_py()], pa.string()), pa.array([words.as_py()], pa.list_(pa.string())), pa.array([numbers.tobytes()], pa.binary()), pa.array([starts.as_py()], pa.int32())]
                    yield pa.RecordBatch.from_arrays(held, names=["lang", "words", "numbers", "starts"])

    schema = "ids binary, starts int" if last else "lang string, words array<string>, numbers binary, starts int"
    return rows.select("lang", "words", "numbers", "starts").mapInArrow(run, schema)


def renumbered(cut: DataFrame, words: DataFrame, n_words: int, share: int) -> DataFrame:
    """(ids, starts): ``blocks`` by the numbers of ``words`` (lang, word, id from 0 to n_words - 1), which are broadcast by shares of ``share``."""
    for low in range(0, max(1, n_words), share):
        some = words.where((F.col("id") >= low) & (F.col("id") < low + share)).select("lang", "word", "id").toArrow()
        cut = stored(_resolved(cut, some, low + share >= n_words), "collocation-texts")
    return cut


class Trie:
    """Double-array trie of sorted distinct phrases: ``words`` whole word numbers and the first ``digits`` digits of one more."""

    def __init__(self, rows: np.ndarray, digits: int, per_word: int):
        self.rows = rows = rows[np.lexsort(rows.T[::-1])]
        self.per_word, self.digits, self.words = per_word, digits, rows.shape[1] - (digits > 0)
        columns = [(rows[:, w] >> DIGIT_BITS * d) & DIGITS - 1 for w in range(self.words) for d in range(per_word - 1, -1, -1)]
        columns += [(rows[:, -1] >> DIGIT_BITS * d) & DIGITS - 1 for d in range(digits - 1, -1, -1)]
        # nodes level by level: a row starts one where it differs from the row before in a digit so far
        node, n_nodes, new = np.zeros(len(rows), np.int64), 1, np.concatenate([[True], np.zeros(len(rows) - 1, bool)])
        parents, labels = [], []
        for column in columns:
            new = new | np.concatenate([[True], column[1:] != column[:-1]])
            parents.append(node[new])
            labels.append(column[new].astype(np.int64))
            node = n_nodes + np.cumsum(new) - 1
            n_nodes += int(new.sum())
        parent, label = np.concatenate(parents), np.concatenate(labels)
        start = self._placed(parent, label, n_nodes)
        slot = np.concatenate([[0], start[parent] + label])
        self.base, self.check = np.zeros(int(slot.max()) + DIGITS + 1, np.int32), np.full(int(slot.max()) + DIGITS + 1, -1, np.int32)
        self.base[slot] = start
        self.check[slot[1:]] = slot[parent]
        self.base[slot[node]] = np.arange(len(rows))  # a leaf has no children: its number

    @staticmethod
    def _placed(parent: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
        """Where the children of each node start, so that no two nodes' children meet in a slot; slot 0 is the root.

        All nodes try a random place, those with most children first in line; what does not fit tries again in more room.
        """
        children = np.bincount(parent, minlength=n)
        at, some = np.zeros(n, np.int64), np.random.default_rng(0)
        order = np.argsort(children[parent], kind="stable")
        parent, label = parent[order], label[order]
        room = len(parent) + len(parent) // 4 + DIGITS
        taken = np.zeros(room + DIGITS, bool)
        taken[0] = True
        while len(parent):
            at[parent] = some.integers(0, room, n)[parent]
            slot, claim = at[parent] + label, np.full(len(taken), -1, np.int64)
            claim[slot] = parent  # of several the last, which has most children
            met = np.zeros(n, bool)
            met[parent[taken[slot] | (claim[slot] != parent)]] = True
            fits = ~met[parent]
            taken[slot[fits]] = True
            if fits.mean() < 0.1:
                room += len(parent) // 4 + DIGITS
                taken = np.concatenate([taken, np.zeros(room + DIGITS - len(taken), bool)])
            parent, label = parent[~fits], label[~fits]
        return at

    def _step(self, place: np.ndarray, state: np.ndarray, word: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and states that go on with the first ``digits`` digits of ``word``."""
        for d in range(self.per_word - 1, self.per_word - 1 - digits, -1):
            to = self.base[state] + (word >> DIGIT_BITS * d & DIGITS - 1).astype(np.int32)
            keep = self.check[to] == state
            place, state, word = place[keep], to[keep], word[keep]
        return place, state

    def states(self, ids: np.ndarray, starts: int, longest: int) -> np.ndarray:
        """The accepting state of each place in ``ids`` before ``starts`` where a phrase of the trie stands and a word goes on with it.

        All places step together, digit by digit, and those without a next node fall out. The accepting states are the leaves' children, one
        for each digit that may be next.
        """
        ids = np.concatenate([ids, np.full(longest, -1, np.int32)])
        # the first word is stepped once for each number there is
        first = np.full(int(ids.max()) + 2, -1, np.int32)
        known, state = self._step(np.arange(len(first) - 1), np.zeros(len(first) - 1, np.int32), np.arange(len(first) - 1), self.per_word)
        first[known] = state
        state = first[ids[:starts]]  # -1 takes the last
        place = np.flatnonzero(state >= 0)
        state = state[place]
        for w in range(1, self.words + (self.digits > 0)):
            there = ids[place + w]
            place, state, there = (c[there >= 0] for c in (place, state, there))
            place, state = self._step(place, state, there, self.per_word if w < self.words else self.digits)
        there = ids[place + self.words]
        state, there = state[there >= 0], there[there >= 0]
        return self.base[state].astype(np.int64) * DIGITS + (there >> DIGIT_BITS * (self.per_word - 1 - self.digits) & DIGITS - 1)


def extended(texts: DataFrame, trie: Trie, longest: int, least: int) -> DataFrame:
    """(ids, f): the phrases of ``trie`` with one digit more that occur at least ``least`` times in all ``texts``.

    Every task adds up the accepting states of its places; the sums are added by ranges of states.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(trie)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        counts = np.zeros(len(trie.rows) * DIGITS, np.int64)
        for batch in batches:
            for ids, starts in zip(batch.column(0), batch.column(1)):
                found = trie.states(np.frombuffer(ids.as_py(), np.int32), starts.as_py(), longest)
                counts += np.bincount(found, minlength=len(counts))
        there = np.flatnonzero(counts)
        part = there >> RANGE_BITS
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(there) else np.zeros(1, np.int64)
        low, some = (there & (1 << RANGE_BITS) - 1).astype(np.uint16), counts[there].astype(np.uint32)
        for a, b in zip(bounds, bounds[1:]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[a])]), pa.array([low[a:b].tobytes()], pa.binary()), pa.array([some[a:b].tobytes()], pa.binary())], names=["part", "low", "counts"]
            )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, low, counts in zip(*batch.to_pydict().values()):
                held = sums.setdefault(part, np.zeros(1 << RANGE_BITS, np.int64))
                held[np.frombuffer(low, np.uint16)] += np.frombuffer(counts, np.uint32)
        trie = sent.value
        for part, held in sums.items():
            state = np.flatnonzero(held >= least)
            f = held[state]
            state += part << RANGE_BITS
            rows, digit = trie.rows[state // DIGITS], (state % DIGITS).astype(np.int32)
            more = rows[:, -1] << DIGIT_BITS | digit if trie.digits else digit
            rows = np.column_stack([rows[:, :trie.words], more]).astype(np.int32)
            ids = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(f)], names=["ids", "f"])

    sums = texts.mapInArrow(count, "part long, low binary, counts binary").repartition("part")
    return stored(sums.mapInArrow(total, "ids array<int>, f long"), "collocation-phrases")


def _tries(phrases: DataFrame, digits: int, per_word: int, leaves: int) -> Iterator[Trie]:
    """Tries of all ``phrases``, of at most ``leaves`` each, one at a time on the driver."""
    n = phrases.count()
    if n > leaves:
        place = F.monotonically_increasing_id()
        within = F.shiftright(place.bitwiseAND((1 << 33) - 1), int(math.log2(leaves)))
        shard = F.shiftleft(F.shiftright(place, 33), 33) + within
        phrases = stored(phrases.repartitionByRange(math.ceil(n / leaves), "ids").withColumn("shard", shard), "collocation-shards")
        parts = [phrases.where(F.col("shard") == r["shard"]) for r in phrases.select("shard").distinct().collect()]
    else:
        parts = [phrases] if n else []
    for part in parts:
        ids = part.select("ids").toArrow().column(0).combine_chunks()
        flat = ids.flatten().to_numpy()
        yield Trie(flat.reshape(len(ids), -1), digits, per_word)


def frequent_phrases(texts: DataFrame, words: DataFrame, n_words: int, longest: int, least: int, leaves: int = LEAVES) -> list[DataFrame]:
    """Tables (ids, f) of the phrases of 1, 2, ... ``longest`` words that occur at least ``least`` times.

    A phrase's digits are those of its words' numbers. Whatever digits a frequent phrase starts with are frequent too, so
    the candidates with one digit more are all children of the frequent ones so far, and nothing else need be counted.
    """
    per_word = 1
    while DIGITS**per_word < n_words:
        per_word += 1
    tables = [words.select(F.array("id").alias("ids"), "f")]
    for _ in range(longest - 1):
        phrases = tables[-1]
        for digits in range(per_word):
            found = [extended(texts, trie, longest, least) for trie in _tries(phrases, digits, per_word, leaves)]
            phrases = found[0] if found else phrases.limit(0)
            for more in found[1:]:
                phrases = phrases.unionByName(more)
        tables.append(phrases)
    return tables


def _scored(tables: list[DataFrame]) -> DataFrame:
    """(ids, a, cut, l, r): every phrase of two words or more with each of its cuts and the frequencies of both parts."""
    all_parts, phrases = tables[0], None
    for k, table in enumerate(tables[1:], 2):
        all_parts = all_parts.unionByName(table)
        part = table.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("cut"))
        phrases = part if phrases is None else phrases.unionByName(part)
    cuts = phrases.select(
        "*", F.slice("ids", F.lit(1), F.col("cut")).alias("left"), F.slice("ids", F.col("cut") + 1, F.size("ids") - F.col("cut")).alias("right")
    )
    left, right = all_parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), all_parts.select(F.col("ids").alias("right"), F.col("f").alias("r"))
    return cuts.join(left, "left").join(right, "right").select("ids", "a", "cut", "l", "r")


def _covered(tables: list[DataFrame], percent: int) -> DataFrame:
    """(ids): phrases inside a longer one that is ``percent`` as frequent. One a word longer is never less frequent than longer ones."""
    found = None
    for k, longer in enumerate(tables[2:], 2):
        for start in (1, 2):
            part = longer.select(F.slice("ids", start, k).alias("ids"), F.col("f").alias("longer"))
            found = part if found is None else found.unionByName(part)
    most = found.groupBy("ids").agg(F.max("longer").alias("longer"))
    phrases = tables[1]
    for table in tables[2:-1]:
        phrases = phrases.unionByName(table)
    return phrases.join(most, "ids").where(100 * F.col("longer") >= percent * F.col("f")).select("ids")


def mine(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000, leaves: int = LEAVES,
    block: int = BLOCK,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words in each language.

    Texts are lower-cased (A-Z) and cut to pieces at ``ENDS`` and to words at space and tab. ``n`` counts all words of the language, ``a`` the
    places of the phrase within pieces, at least ``least``. Of the cuts of a phrase in two parts, with frequencies ``l`` and ``r``, the
    one of least floor(1000 a n / (l r)) counts, of equal ones the first. Phrases inside a longer frequent one
    with at least ``percent`` of their frequency are left out. Each language gives its first ``top`` by score and a, descending, and phrase.

    A NULL language is ``und``; NULL and empty texts have no words; repeated rows count each time; other columns
    are not read; an empty table gives an empty one. A text of any length is dealt with in slices, its phrases across
    of ``block`` words included. ``leaves`` bounds a broadcast trie, a power of 2; more phrases take more tries, each a pass over the stored numbers.
    """
    if longest < 2 or leaves & leaves - 1:
        raise ValueError("phrases have two words or more, tries a power of 2 of leaves")
    ship_package(docs.sparkSession)
    cut = stored(blocks(docs, lang_col, text_col, longest, block), "collocation-blocks")
    each = cut.select("lang", F.inline(F.arrays_zip("words", "counts"))).withColumnRenamed("words", "word")
    totals = cut.groupBy("lang").agg(F.sum("total").alias("n"))
    counted = each.groupBy("lang", "word").agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    words = stored(_numbered(counted).join(totals, "lang"), "collocation-vocabulary")
    n_words = words.count()
    texts = renumbered(cut, words, n_words, leaves)
    tables = frequent_phrases(texts, words, n_words, longest, least, leaves)

    exact = "decimal(19,0)"
    score = F.expr(f"(1000 * CAST(a AS {exact}) * CAST(n AS {exact})) div (CAST(l AS {exact}) * CAST(r AS {exact}))")
    cuts = _scored(tables)
    if longest > 2:
        cuts = cuts.join(_covered(tables, percent), "ids", "left_anti")
    of = words.select(F.col("id").alias("first"), "lang", "n")
    best = cuts.withColumn("first", F.col("ids")[0]).join(of, "first").groupBy("ids", "lang", "n", "a").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    )
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    rows = best.join(spelled, "ids").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
