"""Byte-pair encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

Reads the vocabulary file of a word-end tokenizer (lower case, blanks dropped, ``</w>`` at word ends).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words kept per Python worker with their packed ids and pieces, so a frequent word is merged once.  The memory is
#: cleared when it is full; with the longest word it bounds the bytes (about 60 MB).
CACHE_WORDS = 200_000
CACHE_CHARS = 64


@dataclass(frozen=True)
class Vocabulary:
    """What the tokenizer file holds: ids by piece, merge ranks by pair of pieces, special strings, the word end."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    word_pattern: str
    word_end: str


def read_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file on the driver; it is broadcast, and its size is that of the file (some MB)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(model["vocab"], {tuple(pair): rank for rank, pair in enumerate(model["merges"])},
                      {t["content"]: t["id"] for t in spec["added_tokens"]}, split["pattern"]["Regex"],
                      model["end_of_word_suffix"])


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def merge_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge neighbours by rank, the leftmost first among equal ranks.

    The symbols are a doubly linked list; the queue holds (rank, left position, merged text).  An entry is stale if
    its left symbol is gone or no longer forms this pair with its right neighbour; it is skipped when it comes up.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    text: list[str | None] = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    rank = ranks.get
    queue = [(r, i) for i in range(n - 1) if (r := rank((text[i], text[i + 1]))) is not None]
    heapify(queue)
    while queue:
        r, i = heappop(queue)
        j = after[i]
        if text[i] is None or j < 0 or rank((text[i], text[j])) != r:
            continue
        text[i] += text[j]
        text[j] = None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := rank((text[i], text[k]))) is not None:
                heappush(queue, (r, i))
        h = before[i]
        if h >= 0 and (r := rank((text[h], text[i]))) is not None:
            heappush(queue, (r, h))
    return [t for t in text if t is not None]


class Encoder:
    """Encodes and decodes texts with one vocabulary; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.letters = byte_letters()
        self.words = regex.compile(v.word_pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) or r"(?!)")
        self.pieces = {i: p for p, i in v.ids.items()} | {i: s for s, i in v.special.items()}
        self.cache: dict[str, tuple[bytes, str]] = {}

    def _parts(self, text: str) -> list[tuple[bytes, str]]:
        """Packed ids and joined pieces of each special string and word, in order.

        Special strings keep their own id; what lies between them is normalised, cut into words and merged.
        """
        out, at = [], 0
        if self.vocabulary.special:
            for m in self.special.finditer(text):
                out += self._plain(text[at:m.start()])
                out.append(self._packed([self.vocabulary.special[m.group()]]))
                at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        cache, words = self.cache, self.words.findall(_normal(text))
        for word in words:
            if word not in cache and len(word) <= CACHE_CHARS:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[word] = self._word(word)
        # A word may be too long to be kept, or gone since the memory was cleared.
        return [cache.get(w) or self._word(w) for w in words]

    def _word(self, word: str) -> tuple[bytes, str]:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.vocabulary.word_end
        return self._packed([self.vocabulary.ids[s] for s in merge_word(symbols, self.vocabulary.ranks)])

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, dtype="<u4").tobytes(), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_and_decode(text)[0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The pieces of the ids, joined by blanks as the tokenizer file names no decoder; unknown ids are left out."""
        pieces = self.pieces
        return " ".join(pieces[i] for i in ids if i in pieces)

    def encode_and_decode(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a text, and what they decode to; the pieces of a word are joined once, with its ids."""
        parts = self._parts(text)
        return b"".join([ids for ids, _ in parts]), " ".join([pieces for _, pieces in parts])


def _normal(text: str) -> str:
    """Composed form, lower case letter by letter (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


_WORKER: list[tuple[Vocabulary, Encoder]] = []


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this Python worker, kept between tasks with the words it remembers."""
    if not _WORKER or _WORKER[0][0] != vocabulary:
        _WORKER[:] = [(vocabulary, Encoder(vocabulary))]
    return _WORKER[0][1]


def _with_encoder(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    shared = spark.sparkContext.broadcast(read_vocabulary(path))
    return lambda: _encoder(shared.value)


def encode(spark: SparkSession, text: Column, path: str) -> Column:
    """Token ids of the whole text as binary, each a little-endian unsigned 32-bit integer (see ``unpacked``).

    NULL and empty texts have no ids.  No special tokens are added, nothing is cut or padded.  A text is one row of
    work and no rows meet, so hot sources and copies need no care; frequent words are merged once per worker.
    """
    encoder = _with_encoder(spark, path)

    @F.arrow_udf("binary")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = encoder()
        for texts in batches:
            yield pa.array([of.encode_and_decode(t.as_py() or "")[0] for t in texts], type=pa.binary())

    return ids_of(text)


def encode_and_decode(spark: SparkSession, text: Column, path: str) -> Column:
    """struct(ids, decoded): what ``encode`` gives and what ``decode`` makes of it, by one Python worker."""
    encoder = _with_encoder(spark, path)
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = encoder()
        for texts in batches:
            yield pa.array([dict(zip(("ids", "decoded"), of.encode_and_decode(t.as_py() or ""))) for t in texts], type=kind)

    return both(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The decoded text of packed ids; NULL becomes the empty text."""
    encoder = _with_encoder(spark, path)

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = encoder()
        for rows in batches:
            yield pa.array([of.decode(np.frombuffer(r.as_py() or b"", dtype="<u4").tolist()) for r in rows],
                           type=pa.string())

    return text_of(ids)


def unpacked(ids: Column) -> Column:
    """Packed ids as array<bigint>."""
    def number(i):
        return F.conv(F.concat(*[F.hex(F.substring(ids, 4 * i + k, F.lit(1))) for k in (4, 3, 2, 1)]), 16, 10).cast("bigint")

    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<bigint>"))
