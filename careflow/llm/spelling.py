"""Spelling variants: words within one edit, found by search schemes on bidirectional FM-indexes, grouped under frequent forms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import ship_package, stored

#: Letters of a word: a-z (A-Z are lower-cased) and the letters and signs from U+00C0 to U+00FF.
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of the words of an index; words that share a half beyond half of it are dealt out to several.
BLOCK = 1 << 19
#: Words that are searched at once.
QUERIES_AT_ONCE = 1 << 13


class Side:
    """The Burrows-Wheeler transform of a cyclic text as a wavelet matrix: ranges of its rotations that start with a pattern."""

    def __init__(self, text: np.ndarray, bits: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], key[order][1:] != key[order][:-1]]).cumsum()
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1 or step >= n:
                break
            step *= 2
        self.places, self.bits = order, bits
        codes = text[order - 1]
        self.smaller = np.concatenate([[0], np.bincount(text, minlength=1 << bits).cumsum()])
        self.zeros, self.ranks = [], []
        for b in range(bits - 1, -1, -1):
            zero = codes >> b & 1 == 0
            self.ranks.append(np.concatenate([[0], zero.cumsum()]).astype(np.int32))
            self.zeros.append(int(zero.sum()))
            codes = np.concatenate([codes[zero], codes[~zero]])
        # where a symbol's occurrences start in the last level, against where its rotations start
        at = np.zeros(1 << bits, np.int64)
        symbols = np.arange(1 << bits)
        for level, b in enumerate(range(bits - 1, -1, -1)):
            before = self.ranks[level][at]
            at = np.where(symbols >> b & 1, self.zeros[level] + at - before, before)
        self.shift = self.smaller[:-1] - at

    def extend(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges after putting ``symbol`` before the pattern: (first rotation, number, number of rotations preceded by smaller symbols)."""
        high, less = low + size, np.zeros(len(low), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            below, above = self.ranks[level][low].astype(np.int64), self.ranks[level][high].astype(np.int64)
            less += np.where(one, above - below, 0)
            low = np.where(one, self.zeros[level] + low - below, below)
            high = np.where(one, self.zeros[level] + high - above, above)
        return low + self.shift[symbol], high - low, less

    def extensions(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for all symbols that stand before the pattern somewhere: (range, symbol, first, number, smaller)."""
        of, symbol, high = np.arange(len(low)), np.zeros(len(low), np.int64), low + size
        for level in range(self.bits):
            below, above = self.ranks[level][low].astype(np.int64), self.ranks[level][high].astype(np.int64)
            low = np.column_stack([below, self.zeros[level] + low - below]).ravel()
            high = np.column_stack([above, self.zeros[level] + high - above]).ravel()
            of, symbol = np.repeat(of, 2), np.column_stack([symbol * 2, symbol * 2 + 1]).ravel()
            there = high > low
            of, symbol, low, high = of[there], symbol[there], low[there], high[there]
        number = high - low
        so_far = np.cumsum(number) - number
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        less = so_far - so_far[np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))] if len(of) else so_far
        return of, symbol, low + self.shift[symbol], number, less


class Index:
    """Bidirectional FM-index of distinct words, each after a delimiter; the last delimiter's text goes on at the first word."""

    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters = np.unique(letters)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int(lengths.sum()) + len(words), np.int64)
        inside = np.ones(len(text), bool)
        inside[starts] = False
        text[inside] = np.searchsorted(self.letters, letters) + 1
        bits = max(1, int(len(self.letters)).bit_length())
        self.word_at = np.cumsum(~inside) - 1
        self.n = len(text)
        self.left, self.right = Side(text, bits), Side(text[::-1].copy(), bits)

    def near(self, words: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a word of ``words``, number of an indexed word) at exactly one edit outside one half of the former.

        With ``first_half`` that half, n // 2 code points, and the delimiter before it must match, which ranges of rotations tell by going
        from the middle to the left; then they are extended to the right over the other half, allowing for one symbol that
        is inserted, dropped or replaced, to the closing delimiter. Else the other way round. A pair may come twice.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        found = np.searchsorted(self.letters, codes)
        known = (found < len(self.letters)) & (self.letters[np.minimum(found, len(self.letters) - 1)] == codes) if len(self.letters) else np.zeros(len(codes), bool)
        codes = np.where(known, found + 1, -1)
        length = np.fromiter(map(len, words), np.int64, len(words))
        start, half = np.cumsum(length) - length, length // 2
        if not first_half:
            codes, start, half = codes[::-1], len(codes) - start - length, length - half
        one, other = (self.left, self.right) if first_half else (self.right, self.left)
        pairs = []
        for a in range(0, len(words), QUERIES_AT_ONCE):
            b = slice(a, a + QUERIES_AT_ONCE)
            q, place = self._scheme(one, other, codes, start[b], length[b], half[b])
            pairs.append((q + a, place))
        q, place = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        # the range in the left side tells where the match starts
        return q, self.word_at[self.left.places[place]]

    def _scheme(self, one: Side, other: Side, codes: np.ndarray, start: np.ndarray, length: np.ndarray, half: np.ndarray):
        q = np.arange(len(start))
        x, y, size = (np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n))
        ready = []
        step = 0
        while len(q):
            symbol = np.where(step < half[q], codes[start[q] + np.maximum(half[q] - 1 - step, 0)], 0)
            keep = symbol >= 0
            q, x, y, size, symbol = q[keep], x[keep], y[keep], size[keep], symbol[keep]
            x, size, less = one.extend(x, size, symbol)
            y, keep = y + less, size > 0
            q, x, y, size = q[keep], x[keep], y[keep], size[keep]
            done = half[q] == step
            ready.append((q[done], x[done], y[done], size[done]))
            q, x, y, size, step = q[~done], x[~done], y[~done], size[~done], step + 1
        # from here on ranges of the other side are extended: x and y change places
        q, y, x, size = (np.concatenate(c) for c in zip(*ready)) if ready else (q, x, y, size)
        at = half[q]
        wrong = tuple(np.zeros(0, np.int64) for _ in range(5))
        out = []

        def expected(q: np.ndarray, at: np.ndarray) -> np.ndarray:
            inside = at < length[q]
            return np.where(inside, codes[np.where(inside, start[q] + at, 0)], 0)

        while len(q) or len(wrong[0]):
            wq, wx, wy, wsize, wat = wrong
            symbol = expected(wq, wat)
            keep = symbol >= 0
            wq, wx, wy, wsize, wat, symbol = (c[keep] for c in (wq, wx, wy, wsize, wat, symbol))
            wx, wsize, less = other.extend(wx, wsize, symbol)
            wy, keep, ends = wy + less, wsize > 0, wat == length[wq]
            out.append((wq[keep & ends], wx[keep & ends], wy[keep & ends]))
            keep &= ~ends
            spread = [(wq[keep], wx[keep], wy[keep], wsize[keep], wat[keep] + 1)]
            # one symbol of the word dropped; of equal ones in a row the last
            here, there = expected(q, at), expected(q, np.minimum(at + 1, length[q]))
            drop = (at < length[q]) & (here != there)
            spread.append((q[drop], x[drop], y[drop], size[drop], at[drop] + 1))
            of, symbol, ex, esize, less = other.extensions(x, size)
            eq, ey, eat, want = q[of], y[of] + less, at[of], here[of]
            letter = symbol > 0
            put = letter & (symbol != want)  # of equal symbols in a row the last is the one put in
            spread.append((eq[put], ex[put], ey[put], esize[put], eat[put]))
            change = put & (eat < length[eq])
            spread.append((eq[change], ex[change], ey[change], esize[change], eat[change] + 1))
            right = letter & (symbol == want) & (eat < length[eq])
            q, x, y, size, at = eq[right], ex[right], ey[right], esize[right], eat[right] + 1
            wrong = tuple(np.concatenate(c) for c in zip(*spread))
        q, x, y = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return q, (y if one is self.left else x)


def runs(text: Column, least: int = 6) -> Column:
    """The maximal runs of letters of a whole text with at least ``least`` of them, A-Z lower-cased; NULL has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))


def _keyed(words: DataFrame, block: int) -> DataFrame:
    """(side, half, key, part, word, n, asks): each word beside all words that it may be near to.

    A word asks where its own first (last) half is the key; it is indexed under the prefixes (suffixes) that are the half of a word one shorter,
    as long or one longer. A key whose words exceed half a block is cut to parts: words are dealt out to them, questions go to all.
    """
    n = F.length("word")
    first, last = (lambda m: F.floor(m / 2).cast("int")), (lambda m: F.ceil(m / 2).cast("int"))
    sides = []
    for side, of in ((0, first), (1, last)):
        sizes = F.array_distinct(F.transform(F.array(n - 1, n, n + 1), of))
        key = F.expr("left(word, half)" if side == 0 else "right(word, half)")
        rows = words.select("word", "n", of(n).alias("own"), F.explode(sizes).alias("half"))
        sides.append(rows.select(F.lit(side).alias("side"), "half", key.alias("key"), "word", "n", (F.col("half") == F.col("own")).alias("asks")))
    rows = sides[0].unionByName(sides[1])
    large = rows.groupBy("side", "half", "key").agg(F.sum(F.length("word") + 1).alias("_size")).where(F.col("_size") > block // 2)
    large = large.select("side", "half", "key", F.ceil(F.col("_size") / (block // 2)).cast("int").alias("_parts"))
    rows = rows.join(large, ["side", "half", "key"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    part = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(own)))
    return rows.select("side", "half", "key", part.alias("part"), own.alias("own"), "word", "n", "asks")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): all pairs, in both directions, of distinct ``words`` (word, n) at exactly one edit.

    An edit is a code point put in, left out or replaced. It leaves one half of the word as it is, so the other word has the
    same first or last half, and both lie under one key; see ``_keyed``. Each task indexes the words under its keys
    (about ``block`` code points) and answers those that ask; see ``Index.near``. Words must be longer than one code point, and no NULL.
    """
    ship_package(words.sparkSession)
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    rows = _keyed(words, block).repartition(max(1, math.ceil(4 * total / block)), "side", "half", "key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        counts: list[int] = []
        asks: tuple[list[str], list[str]] = [], []
        for batch in batches:
            for side, here, word, n, ask in zip(*(batch.column(c).to_pylist() for c in ("side", "here", "word", "n", "asks"))):
                if here and word not in numbers:
                    numbers[word] = len(counts)
                    counts.append(n)
                if ask:
                    asks[side].append(word)
        indexed, count = list(numbers), np.array(counts, np.int64)
        index = Index(indexed) if indexed else None
        for side in (0, 1):
            asking = list(dict.fromkeys(asks[side]))
            for a in range(0, len(asking) if index else 0, QUERIES_AT_ONCE):
                some = asking[a:a + QUERIES_AT_ONCE]
                found = np.unique(np.column_stack(index.near(some, side == 0)), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some[i] for i in found[:, 0]], pa.string()), pa.array([indexed[j] for j in found[:, 1]], pa.string()), pa.array(count[found[:, 1]])],
                    names=["word", "near", "near_n"],
                )

    here = (F.col("own") == F.col("part")).alias("here")
    found = rows.select("side", here, "word", "n", "asks").mapInArrow(run, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def group_variants(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word string, n long, other columns are left out).

    ``n_near`` counts the words at exactly one edit. The form is that of greatest n among them, the first by code points of equal
    ones, if it has ``ratio`` (at least 2) times the word's n; else NULL. ``root`` follows forms to the last. Rows with a NULL word
    or n, or words of less than two code points, are left out, and of repeated words those of lesser n; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = words.where((F.length("word") > 1) & F.col("n").isNotNull()).groupBy("word").agg(F.max("n").cast("long").alias("n"))
    words = stored(words, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    of = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= ratio * F.col("n")
    formed = stored(
        words.join(of, "word", "left").select(
            "word", F.when(often, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, -F.col("best.less")).alias("form_n")
        ), "spelling-forms",
    )
    # n grows by the ratio at each step, which bounds the steps; each round doubles those that a root has gone
    least, most = formed.agg(F.min("n"), F.max("n")).first()
    steps = math.ceil(math.log(most / max(1, least), ratio)) + 1 if most else 0
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
