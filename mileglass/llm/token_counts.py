"""Exact token counts of every prefix by dynamic programming, for a byte-pair vocabulary with scored pieces.

A sequence of pieces is the encoding of its text exactly if every two neighbours are the encoding of their joined
text.  So the last piece of a prefix is the one piece ending there that agrees with the last piece of the prefix
before it, and one pass over the text gives the token count of all its prefixes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BLANK = "▁"  # stands for the blank in pieces
CACHE_CHUNKS = 400_000
CACHE_PAIRS = 1_000_000
CACHE_CHARS = 256
CACHE_STEPS = 1_000_000
GROUP_TEXTS = 500
_NUMBERS = 1 << 21  # more than there are pieces
_NORMAL, _BYTE = 1, 6  # kinds of pieces in the model file


@dataclass(frozen=True)
class PieceModel:
    """Scores of the pieces that merging can form, and whether a blank is put in front of a text."""

    scores: dict[str, float]
    leading_blank: bool


def read_piece_model(path: str) -> PieceModel:
    """Read a model file on the driver; it is broadcast, and its size is that of the file (some MB).

    Only what the counts rely on is accepted: merges by score, bytes for unknown characters, texts left as they are.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    kinds = {p.type for p in model.pieces}
    if (model.trainer_spec.model_type != 2 or _BYTE not in kinds or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces or 4 in kinds):
        raise ValueError("this model needs a normalisation or pieces that are not supported")
    return PieceModel({p.piece: p.score for p in model.pieces if p.type == _NORMAL}, norm.add_dummy_prefix)


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The pieces of ``text`` by merging: the best score first, the leftmost among equal ones."""
    n, part = len(text), list(text)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(-s, i, part[i] + part[i + 1]) for i in range(n - 1)
             if (s := scores.get(part[i] + part[i + 1])) is not None]
    heapify(queue)
    while queue:
        _, i, joined = heappop(queue)
        j = after[i]
        if not part[i] or j < 0 or part[i] + part[j] != joined:
            continue
        part[i], part[j] = joined, ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0 and (s := scores.get(part[a] + part[b])) is not None:
                heappush(queue, (-s, a, part[a] + part[b]))
    return [p for p in part if p]


class PrefixCounter:
    """Token counts of all prefixes of texts; one per Python worker."""

    def __init__(self, model: PieceModel):
        self.scores, self.leading_blank = model.scores, model.leading_blank
        pieces = [p for p in model.scores if merge(p, model.scores) == [p]]  # others never come out
        self.names = dict(enumerate(pieces))
        self._follow(pieces)
        self.inner = {a + b for p in pieces for a, b in zip(p, p[1:])}
        # Cutting between two characters is safe if no piece holds them side by side: before a run of blanks, and
        # around characters that are in no longer piece.
        if any(pair[1] == BLANK and pair[0] != BLANK for pair in self.inner):
            raise ValueError("pieces must not hold a blank after another character")
        loners = "".join(c for c in "\n\r\t\x0b\x0c" if not any(c in pair for pair in self.inner))
        own = f"[{re.escape(loners)}]|" if loners else ""
        not_own = re.escape(loners)
        self.chunks = re.compile(f"{own}{BLANK}*[^{BLANK}{not_own}]+|{BLANK}+")
        self.agree: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _follow(self, pieces: list[str]) -> None:
        """An automaton over the pieces: each state knows the pieces that end there, the longest first."""
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        depth = [0]
        for number, p in enumerate(pieces):
            at = 0
            for c in p:
                if c not in self.steps[at]:
                    self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    self.ends.append(())
                    depth.append(depth[at] + 1)
                at = self.steps[at][c]
            self.ends[at] = ((len(p), number),)
        self.shorter = [0] * len(self.steps)  # the state of the longest proper ending
        self.room = 0
        for at in sorted(range(len(self.steps)), key=depth.__getitem__):
            for c, below in self.steps[at].items():
                self.shorter[below] = self._step(self.shorter[at], c) if at else 0
                self.ends[below] += self.ends[self.shorter[below]]
        self.room = CACHE_STEPS

    def _step(self, at: int, c: str) -> int:
        """The state after one more character; remembered while there is room."""
        first = at
        while (found := self.steps[at].get(c)) is None and at:
            at = self.shorter[at]
        found = found or 0
        if self.room:
            self.room -= 1
            self.steps[first][c] = found
        return found

    def _agree(self, last: int, number: int) -> bool:
        """Whether two pieces are the encoding of their joined text; a character without a piece has number -1 - code."""
        a, b = (self.names[k] if k >= 0 else chr(-1 - k) for k in (last, number))
        if len(self.agree) >= CACHE_PAIRS:
            self.agree.clear()
        found = self.agree[last * _NUMBERS + number] = merge(a + b, self.scores) == [a, b]
        return found

    def chunk_counts(self, chunks: set[str]) -> dict[str, tuple[int, ...]]:
        """Token counts of the prefixes of 1, 2, ... characters of each chunk.

        New chunks are taken in order, so that each goes on from the prefix it shares with the one before.
        """
        known = self.known
        out = {c: known[c] for c in chunks if c in known}
        counts, last, states, before = [0], [0], [0], ""
        for c in sorted(chunks - out.keys()):
            same = 0
            for x, y in zip(before, c):
                if x != y:
                    break
                same += 1
            del counts[same + 1:], last[same + 1:], states[same + 1:]
            self._go_on(c, same, counts, last, states)
            before = c
            found = out[c] = tuple(counts[1:])
            if len(c) <= CACHE_CHARS:
                if len(known) >= CACHE_CHUNKS:
                    known.clear()
                known[c] = found
        return out

    def _go_on(self, text: str, done: int, counts: list[int], last: list[int], states: list[int]) -> None:
        """Extend the table of ``text`` from its first ``done`` characters to all of them."""
        agree, steps, ends, at = self.agree, self.steps, self.ends, states[-1]
        for end in range(done + 1, len(text) + 1):
            c = text[end - 1]
            after = steps[at].get(c)
            at = self._step(at, c) if after is None else after
            states.append(at)
            for length, number in ends[at]:
                start = end - length
                if start:
                    fits = agree.get(last[start] * _NUMBERS + number)
                    if not (self._agree(last[start], number) if fits is None else fits):
                        continue
                counts.append(counts[start] + 1)
                last.append(number)
                break
            else:  # a character that no piece covers is spelled in bytes
                counts.append(counts[end - 1] + len(c.encode()))
                last.append(-1 - ord(c))

    def _chunks(self, text: str) -> list[str]:
        return self.chunks.findall((BLANK if self.leading_blank and text else "") + text.replace(" ", BLANK))

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... characters of ``text``."""
        counts, chunks = [0], self._chunks(text)
        found = self.chunk_counts(set(chunks))
        for c in chunks:
            done = counts[-1]
            counts += [done + n for n in found[c]]
        if self.leading_blank and text:
            del counts[1]  # that of the blank put in front
        return np.array(counts, dtype=np.int64)

    def summaries(self, texts: list[str], budget: int) -> list[tuple[int, int]]:
        """Per text the token count, and the number of characters of the longest prefix with at most ``budget`` tokens."""
        out = []
        for at in range(0, len(texts), GROUP_TEXTS):
            split = [self._chunks(t) for t in texts[at:at + GROUP_TEXTS]]
            found = self.chunk_counts(set().union(*split))
            totals = {c: n[-1] for c, n in found.items()}
            out += [self._summary(t, chunks, found, totals, budget) for t, chunks in zip(texts[at:at + GROUP_TEXTS], split)]
        return out

    def _summary(self, text, chunks, found, totals, budget) -> tuple[int, int]:
        total = sum([totals[c] for c in chunks])
        if total <= budget:
            return total, len(text)
        # No chunk after the first end above the budget has a shorter prefix; within a chunk counts go up and down.
        ends = np.cumsum([totals[c] for c in chunks], dtype=np.int64)
        k = int(np.searchsorted(ends, budget, side="right"))
        done = int(ends[k - 1]) if k else 0
        fits = [i for i, n in enumerate(found[chunks[k]], 1) if done + n <= budget]
        chars = sum(map(len, chunks[:k])) + (fits[-1] if fits else 0)
        return total, max(chars - (1 if self.leading_blank else 0), 0)


_WORKER: list[tuple[PieceModel, PrefixCounter]] = []


def _counter(model: PieceModel) -> PrefixCounter:
    """The counter of this Python worker, kept between tasks with what it remembers."""
    if not _WORKER or _WORKER[0][0] != model:
        _WORKER[:] = [(model, PrefixCounter(model))]
    return _WORKER[0][1]


def _with_counter(spark: SparkSession, path: str):
    shared = spark.sparkContext.broadcast(read_piece_model(path))
    return lambda: _counter(shared.value)


def prefix_counts(spark: SparkSession, text: Column, path: str) -> Column:
    """array<bigint>: at index i the exact token count of the first i characters, for the whole text.

    NULL and empty texts give [0].  Stored once, it answers any truncation or budget question without encoding
    again: ``count_at``, ``longest_within``.
    """
    counter = _with_counter(spark, path)

    @F.arrow_udf("array<bigint>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = counter()
        for texts in batches:
            yield pa.array([of.prefixes(t.as_py() or "") for t in texts], type=pa.list_(pa.int64()))

    return counts(text)


def count_at(counts: Column, chars: Column | int) -> Column:
    """Token count of the first ``chars`` characters; of the whole text if it is shorter."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.get(counts, F.least(chars, F.size(counts) - 1))


def longest_within(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens; counts may go down as a text grows."""
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)


def count_tokens(spark: SparkSession, text: Column, path: str, budget: int) -> Column:
    """struct(n_tokens, budget_chars): the last prefix count, and the longest prefix within ``budget`` tokens.

    What ``prefix_counts`` gives, without handing its arrays on.
    """
    counter = _with_counter(spark, path)
    kind = pa.struct([("n_tokens", pa.int64()), ("budget_chars", pa.int64())])

    @F.arrow_udf("struct<n_tokens:bigint,budget_chars:bigint>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = counter()
        for texts in batches:
            rows = of.summaries([t.as_py() or "" for t in texts], budget)
            yield pa.array([{"n_tokens": n, "budget_chars": c} for n, c in rows], type=kind)

    return counted(text)
