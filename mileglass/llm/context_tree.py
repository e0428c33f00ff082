"""Context-tree weighting over bytes: binary decisions, Krichevsky-Trofimov estimates, all depths mixed.

Each byte is eight binary decisions.  A decision is a node 1..255 of the byte's binary tree; for each node there is
a context tree over the preceding bytes.  A context's own estimate and the product of its children are weighted half
and half, at every depth, so the tree is fitted bottom up once from counts and then gives any byte a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mileglass.llm.text import stored

DEPTH = 5
#: Most byte grams of the fitted tree: bounds what is broadcast (at most 8 nodes of 20 bytes for each gram).
MAX_GRAMS = 1_500_000
EDGE = 0xFF  # never a byte of UTF-8: stands before a text and ends it
_CHUNK = 1 << 18
#: Grams that are sorted at once; each of them takes some 50 bytes meanwhile.
_MERGE = 1 << 19
#: Distinct grams that a task holds before it passes them on.
_HELD = 1 << 21
_ROWS = 1 << 16


def _padded(text: bytes, depth: int) -> np.ndarray:
    return np.frombuffer(bytes([EDGE]) * depth + text + bytes([EDGE]), dtype=np.uint8)


def _grams(padded: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of the text and its end: the ``depth`` bytes before it and itself, as one number."""
    n = len(padded) - depth
    out = np.zeros(n, dtype=np.int64)
    for j in range(depth + 1):
        out = out << 8 | padded[j:j + n]
    return out


def gram_counts(texts: DataFrame, text: str, depth: int = DEPTH) -> DataFrame:
    """(gram, c): how often each run of ``depth`` + 1 bytes occurs in all whole texts, edges included.

    Each task counts its own texts first, in blocks of bounded size, so a run found everywhere is one row a task.
    """
    return (texts.select(F.col(text).cast("binary").alias("t"))
            .mapInArrow(lambda batches: _counted(batches, depth), "gram bigint, c bigint")
            .groupBy("gram").agg(F.sum("c").alias("c")))


def _counted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(gram, c) of the texts in the first column; a gram comes again only if a task finds more than ``_HELD``."""
    keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    waiting, size = [], 0

    def rows():
        for at in range(0, len(keys), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + _ROWS]), pa.array(counts[at:at + _ROWS])], names=["gram", "c"])

    for batch in batches:
        for t in batch.column(0):
            padded = _padded(t.as_py() or b"", depth)
            for at in range(0, len(padded) - depth, _CHUNK):
                waiting.append(_grams(padded[at:at + _CHUNK + depth], depth))
                size += len(waiting[-1])
                if size >= _MERGE:
                    keys, counts = _merged(keys, counts, np.concatenate(waiting))
                    waiting, size = [], 0
                    if len(keys) >= _HELD:
                        yield from rows()
                        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if waiting:
        keys, counts = _merged(keys, counts, np.concatenate(waiting))
    yield from rows()


def _merged(keys: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts, with those of ``grams`` added."""
    new, n = np.unique(grams, return_counts=True)
    at = np.searchsorted(keys, new)
    there = at < len(keys)
    there[there] = keys[at[there]] == new[there]
    counts[at[there]] += n[there]
    return np.insert(keys, at[~there], new[~there]), np.insert(counts, at[~there], n[~there])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


@F.arrow_udf(DoubleType())
def _log_kt(n0: pa.Array, n1: pa.Array) -> pa.Array:
    return pa.array(log_kt(n0.to_numpy(zero_copy_only=False), n1.to_numpy(zero_copy_only=False)))


def _levels(grams: DataFrame, depth: int) -> list[DataFrame]:
    """Gram tables of contexts of 0 to ``depth`` bytes; a shorter one sums the longest ones."""
    longest = stored(grams, "context-grams")
    return [longest.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("gram"))
            .agg(F.sum("c").alias("c")) for d in range(depth)] + [longest]


def _least_count(levels: list[DataFrame], max_grams: int) -> int:
    """The smallest power of two so that contexts seen so often, at all depths, have at most ``max_grams`` grams."""
    sizes: dict[int, int] = {}
    for grams in levels[1:]:
        contexts = (grams.groupBy(F.shiftright("gram", 8).alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("k"))
                    .groupBy(F.floor(F.log2("n")).alias("power")).agg(F.sum("k").alias("k")))
        for r in contexts.collect():  # one row for each power of two
            sizes[r.power] = sizes.get(r.power, 0) + r.k
    power = 0
    while sum(k for p, k in sizes.items() if p >= power) > max_grams:
        power += 1
    return 1 << power


@dataclass
class ContextTree:
    """Fitted nodes by depth, sorted by key (context and node number in one integer).

    ``own`` is the estimate that the next bit is one, ``weight`` the weight of it against the deeper tree, ``rest``
    the estimate of all children that the tree does not hold.  ``grams`` and ``logs`` are the probabilities of bytes
    seen after the deepest contexts, worked out once.
    """

    depth: int
    keys: list[np.ndarray]
    own: list[np.ndarray]
    weight: list[np.ndarray]
    rest: list[np.ndarray]
    grams: np.ndarray
    logs: np.ndarray

    def mixed_logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each gram after the bytes before it, over all depths."""
        byte, out = grams & 0xFF, np.zeros(len(grams))
        contexts = [grams >> 8 & (1 << 8 * d) - 1 for d in range(self.depth + 1)]
        held = [np.ones(len(grams), dtype=bool)]
        for d in range(1, self.depth + 1):
            held.append(held[-1] & self._find(d, contexts[d] << 8 | 1)[1])
        for k in range(8):
            node, bit = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1
            p = np.full(len(grams), 0.5)
            for d in range(self.depth, -1, -1):
                at, there = self._find(d, contexts[d] << 8 | node)
                if len(self.keys[d]):
                    own, weight, rest = self.own[d][at], self.weight[d][at], self.rest[d][at]
                    deeper = np.where(held[d + 1], p, rest) if d < self.depth else own
                    p = np.where(held[d], np.where(there, weight * own + (1 - weight) * deeper, 0.5), p)
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def _find(self, d: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.keys[d]
        if not len(known):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each whole text and its end.

        Texts are taken in blocks of bounded size, long ones in parts; a gram is looked up once a block.
        """
        totals, waiting, size = np.zeros(len(texts)), [], 0

        def add():
            unique, at = np.unique(np.concatenate([g for _, g in waiting]), return_inverse=True)
            owners = np.repeat([i for i, _ in waiting], [len(g) for _, g in waiting])
            totals[:] += np.bincount(owners, weights=self._logs(unique)[at], minlength=len(texts))

        for i, text in enumerate(texts):
            padded = _padded(text, self.depth)
            for at in range(0, len(padded) - self.depth, _CHUNK):
                waiting.append((i, _grams(padded[at:at + _CHUNK + self.depth], self.depth)))
                size += len(waiting[-1][1])
                if size >= _MERGE:
                    add()
                    waiting, size = [], 0
        if waiting:
            add()
        return totals

    def _logs(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return self.mixed_logs(grams)
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        out, missing = self.logs[place].astype(np.float64), self.grams[place] != grams
        out[missing] = self.mixed_logs(grams[missing])
        return out


def fit_context_tree(texts: DataFrame, text: str = "text", depth: int = DEPTH,
                     max_grams: int = MAX_GRAMS) -> ContextTree:
    """The context tree of all whole texts.

    Counting and the weights of each depth are Spark jobs; every depth is stored, and only the fitted nodes come to
    the driver, to be broadcast.  Their number is bounded: contexts seen less often than a power of two are not
    extended, the smallest power for which the tree fits ``max_grams``.  What follows such a context counts towards
    the ``rest`` of the next shorter one, so every byte of the corpus has its part in the tree and every text is
    scored whole.  NULL counts as the empty text.  Without texts all bits have probability one half.
    """
    levels = _levels(gram_counts(texts, text, depth), depth)
    least = _least_count(levels, max_grams)
    tree = ContextTree(depth, [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1),
                       np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    below, kept_grams = None, None
    for d in range(depth, -1, -1):
        grams = levels[d]
        if d and least > 1:
            contexts = grams.groupBy(F.shiftright("gram", 8).alias("s")).agg(F.sum("c").alias("n")).filter(F.col("n") >= least)
            grams = grams.join(contexts.select("s"), F.shiftright("gram", 8) == F.col("s"), "left_semi")
        if d == depth:
            kept_grams = grams.select("gram")
        below = stored(_nodes(grams, below, d), "context-nodes")
        # The bounded model, one depth at a time.
        table = below.select("key", F.expr("float((n1 + 0.5D) / (n0 + n1 + 1))").alias("own"), "weight", "rest").toArrow()
        key = table.column("key").to_numpy()
        order = np.argsort(key)
        tree.keys[d] = key[order]
        tree.own[d], tree.weight[d], tree.rest[d] = (table.column(c).to_numpy()[order] for c in ("own", "weight", "rest"))
    shared = kept_grams.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("float")
    def logs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for g in batches:
            yield pa.array(shared.value.mixed_logs(g.to_numpy()).astype(np.float32))

    table = kept_grams.select("gram", logs(F.col("gram")).alias("log")).toArrow()
    order = np.argsort(table.column("gram").to_numpy())
    shared.destroy()
    tree.grams, tree.logs = table.column("gram").to_numpy()[order], table.column("log").to_numpy()[order]
    return tree


def _nodes(grams: DataFrame, below: DataFrame | None, depth: int) -> DataFrame:
    """(key, n0, n1, logw, weight, rest) of the contexts of one depth, from their grams and the nodes one deeper."""
    byte = F.col("gram").bitwiseAND(F.lit(0xFF))
    steps = F.array(*[F.struct(
        F.shiftright("gram", 8).alias("s"),
        F.lit(1 << k).bitwiseOR(F.shiftright(byte, 8 - k)).alias("node"),
        F.shiftright(byte, 7 - k).bitwiseAND(F.lit(1)).alias("bit")) for k in range(8)])
    key = F.shiftleft("e.s", 8).bitwiseOR(F.col("e.node"))
    nodes = (grams.select("c", F.explode(steps).alias("e"))
             .groupBy(key.cast("bigint").alias("key"))
             .agg(F.sum(F.when(F.col("e.bit") == 0, F.col("c")).otherwise(0)).alias("n0"),
                  F.sum(F.when(F.col("e.bit") == 1, F.col("c")).otherwise(0)).alias("n1"))
             .withColumn("logp", _log_kt(F.col("n0"), F.col("n1"))))
    if below is None:
        return nodes.select("key", "n0", "n1", F.col("logp").alias("logw"), F.lit(1.0).cast("float").alias("weight"),
                            F.lit(0.5).cast("float").alias("rest"))
    return nodes.join(_by_parent(below, depth), "key", "left").select(
        "key", "n0", "n1", "logp", (F.col("n0") - F.coalesce("c0", F.lit(0))).alias("r0"),
        (F.col("n1") - F.coalesce("c1", F.lit(0))).alias("r1"), F.coalesce("logc", F.lit(0.0)).alias("logc")
    ).withColumn("deeper", F.col("logc") + _log_kt(F.col("r0"), F.col("r1"))).select(
        "key", "n0", "n1",
        # log((own + deeper) / 2), from the larger of the two
        (F.greatest("logp", "deeper") + F.log1p(F.exp(-F.abs(F.col("logp") - F.col("deeper")))) - F.log(F.lit(2.0)))
        .alias("logw"),
        (1 / (1 + F.exp(F.col("deeper") - F.col("logp")))).cast("float").alias("weight"),
        F.expr("float((r1 + 0.5D) / (r0 + r1 + 1))").alias("rest"))


def _by_parent(below: DataFrame, depth: int) -> DataFrame:
    """Nodes of contexts of ``depth`` + 1 bytes, summed by the context without its oldest byte."""
    key = F.col("key").bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1))
    return below.groupBy(key.alias("key")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"),
                                               F.sum("logw").alias("logc"))


def score_texts(text: Column, tree: ContextTree, spark) -> Column:
    """log10 of the probability of each whole text (NULL: the empty text) under a fitted tree."""
    shared = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score([t.as_py() or b"" for t in texts]))

    return score(text.cast("binary"))


def bits_per_byte(score: Column, n_bytes: Column) -> Column:
    """Code length per byte of a text and its end."""
    return -score * float(np.log2(10)) / (n_bytes + 1)
