"""Byte-level BPE encoding and decoding with a trie of words that shares the encodings of prefixes."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from careflow.llm.common import ship_package

#: Fixed values of byte-level BPE: the pattern that cuts a text to words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space, as the pattern's ``\\s``. A word of the pattern has a space at most at its start, so that a text may be
#: cut there first: into runs without white space, each with the space before it, and into white space as the pattern cuts it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Encoded runs and checked token pairs that a Python worker remembers before it starts anew.
REMEMBERED = 600_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A vocabulary with its merges. ``source`` is the text of a tokenizer file of byte-level BPE."""

    def __init__(self, source: str):
        file = json.loads(source)
        letter = byte_letters()
        self.ids = {bytes(letter[c] for c in t): i for t, i in file["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        self.names = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes, int]] = {}
        for n, merge in enumerate(file["model"]["merges"]):
            a, b = (bytes(letter[c] for c in t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[a, b] = n
            self.parts.setdefault(a + b, (a, b, n))
        self.never = len(self.rank)
        self.word = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.spines: tuple[dict, dict] = {}, {}
        self.apart: dict[int, bool] = {}
        self.known = {(t,): array("I", [i]).tobytes() for t, i in self.special.items()}
        self.unit = re.compile(UNIT).findall
        # a token that its own merges do not make never appears in an encoding
        self.reachable = {
            t: i for t, i in self.ids.items() if len(t) == 1 or t in self.parts and self._stay(*self.parts[t][:2], self.parts[t][2])
        }
        self.size = {i: len(t) for t, i in self.reachable.items()}
        self.longest = max(self.size.values(), default=1)

    def _spine(self, token: bytes, last: int) -> list[tuple[bytes, int, int]]:
        """(part, rank that makes it, rank that uses it up) of the parts that come to stand at an end of ``token``."""
        found = self.spines[last].get(token)
        if found is None:
            found, used = [], self.never + 1
            part = token
            while True:
                made = self.parts[part][2] if len(part) > 1 else -1
                found.append((part, made, used))
                if len(part) == 1:
                    break
                used, part = made, self.parts[part][1 if last else 0]
            self.spines[last][token] = found
        return found

    def _stay(self, a: bytes, b: bytes, until: int | None = None) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` gives these two tokens and nothing across their border.

        Merges run by rank. Across the border a merge happens if both of its parts stand there at its rank: made before it, and not
        yet used up. Of equal merges the left one runs first, so the left part must not be used at this rank, the right one may.
        ``until`` looks only at merges before that rank.
        """
        rank = self.rank.get
        until = self.never if until is None else until
        for x, x_made, x_used in self._spine(a, 1):
            for y, y_made, y_used in self._spine(b, 0):
                m = rank((x, y))
                if m is not None and m < until and x_made < m < x_used and y_made < m <= y_used:
                    return False
        return True

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit integers.

        The sorted words are their trie, walked depth first: what a word shares with the one before is the path down to the
        node where they part. Every node keeps the last token of the encoding of its prefix, found from those above it: the
        token that ends the prefix and stays apart from the last token of the prefix before it. The last tokens, read
        backwards, are the encoding of a word.
        """
        last: list[int] = []
        before, out = b"", {}
        reachable, apart, size, longest, many = self.reachable, self.apart, self.size, self.longest, len(self.names)
        if len(apart) > REMEMBERED:
            apart.clear()
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, end = 0, min(len(before), len(raw))
            while shared < end and raw[shared] == before[shared]:
                shared += 1
            del last[shared:]
            for i in range(shared + 1, len(raw) + 1):
                for start in range(i - longest if i > longest else 0, i):
                    token = reachable.get(raw[start:i])
                    if token is None:
                        continue
                    if start:
                        pair = last[start - 1] * many + token
                        stay = apart.get(pair)
                        if stay is None:
                            stay = apart[pair] = self._stay(self.names[last[start - 1]], raw[start:i])
                        if not stay:
                            continue
                    last.append(token)
                    break
            tokens, i = [], len(raw)
            while i:
                tokens.append(last[i - 1])
                i -= size[last[i - 1]]
            tokens.reverse()
            out[word] = array("I", tokens).tobytes()
            before = raw
        return out

    def _learn(self, units: set[str]) -> None:
        """Encode runs not seen before: cut them to words, encode the distinct words, join their ids."""
        cut = {u: self.word(u) for u in units}
        ids = self.encode_words({w for words in cut.values() for w in words})
        self.known.update({u: b"".join([ids[w] for w in words]) for u, words in cut.items()})

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; NULL is an empty text. Special tokens' names in a text are their tokens."""
        units: list[list] = []
        for text in texts:
            parts = [text or ""]
            if text and any(name in text for name in self.special):
                parts = self.cut(text)
            found: list = self.unit(parts[0])
            for name, part in zip(parts[1::2], parts[2::2]):
                found.append((name,))
                found += self.unit(part)
            units.append(found)
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.known.update({(t,): array("I", [i]).tobytes() for t, i in self.special.items()})
        known = self.known
        self._learn(set().union(*units).difference(known))
        return [b"".join([known[u] for u in found]) for found in units]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        names = self.names
        return b"".join([names[i] for i in ids.tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(source) -> Encoder:
    """One encoder for each broadcast tokenizer file and Python worker."""
    found = _ENCODERS.get(source.id if hasattr(source, "id") else id(source))
    if found is None:
        _ENCODERS.clear()
        found = _ENCODERS[source.id if hasattr(source, "id") else id(source)] = Encoder(source.value)
    return found


def _slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of a batch with their texts, some millions of characters at a time; a longer text comes alone."""
    start, size, texts = 0, 0, []
    for n, value in enumerate(batch.column(batch.schema.get_field_index(column))):
        text = value.as_py()
        if texts and size + len(text or "") > chars:
            yield batch.slice(start, n - start), texts
            start, size, texts = n, 0, []
        texts.append(text)
        size += len(text or "")
    if texts:
        yield batch.slice(start), texts


def load(spark: SparkSession, path: str):
    """The tokenizer file at ``path``, read by the driver and sent to the executors; its size is that of a vocabulary."""
    ship_package(spark)
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (binary): the ids of each whole text as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a byte-level BPE tokenizer file. Special tokens are not added, but their names in a text are
    encoded as them. NULL and empty texts have no ids. Rows are kept as they are, repeated ones too. Words are encoded
    once per task, in a trie of the distinct new words of each batch; no row leaves its task.
    """
    source = load(docs.sparkSession, tokenizer)
    schema = docs.drop(ids_col).schema.add(ids_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source)
        for batch in batches:
            for rows, texts in _slices(batch, text_col):
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(encoder.encode_batch(texts), pa.binary())], names=[*rows.schema.names, ids_col]
                )

    return docs.drop(ids_col).mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of the ids in ``ids_col``; NULL ids give NULL, no ids an empty text. Repeated rows stay; an empty table gives an empty one."""
    source = load(rows.sparkSession, tokenizer)
    schema = rows.drop(text_col).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = part.column(part.schema.get_field_index(ids_col))
                texts = [None if v is None else encoder.decode(np.frombuffer(v, dtype="<u4")) for v in (x.as_py() for x in ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text_col])

    return rows.drop(text_col).mapInArrow(run, schema)
