"""Context-tree weighting with every context of the corpus, the tree kept as a Spark table.

Grams are ordered by their context read backwards, so the contexts below a node lie side by side.  Ranges of that
order are fitted apart; only nodes above a border between two ranges are finished on the driver.  No context is
dropped: every byte of a training text has all its contexts, so a node's children take all that follows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mileglass.llm import context_tree as CT
from mileglass.llm.text import free_name, stored, text_blocks

#: Grams whose logarithms are broadcast: the most frequent ones, at most so many; the others are joined.
BROADCAST_GRAMS = 1_500_000
#: Grams that are fitted at once in a task.
RANGE_GRAMS = 1 << 16
READ = "struct<score:double,grams:array<bigint>,times:array<bigint>>"
_SPINE = "d int, key bigint, n0 double, n1 double, logc double"


def _backwards(gram: Column, depth: int) -> Column:
    """The gram with its context read from the latest byte to the oldest one, then the byte that follows."""
    out = gram.bitwiseAND(F.lit(0xFF))
    for i in range(depth):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(gram, 8 * (i + 1)).bitwiseAND(F.lit(0xFF)), 8 * (depth - i)))
    return out


def _shorter(keys: np.ndarray) -> np.ndarray:
    """Grams or nodes after the context without its oldest byte."""
    return keys >> 16 << 8 | keys & 0xFF


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


@dataclass
class _Nodes:
    """Nodes of one depth, sorted by key (context and node number in one integer)."""

    keys: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    logc: np.ndarray
    deepest: bool

    def __post_init__(self):
        logp = CT.log_kt(self.n0, self.n1)
        self.own = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)
        self.logw = logp if self.deepest else np.logaddexp(logp, self.logc) - np.log(2)
        self.weight = np.ones(len(logp)) if self.deepest else 1 / (1 + np.exp(np.minimum(self.logc - logp, 700)))

    def below(self, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None, chosen=slice(None)):
        """(keys, done, open): the estimate summed from the root on, and the weight left for deeper contexts."""
        keys, own, weight = self.keys[chosen], self.own[chosen], self.weight[chosen]
        done, left = np.zeros(len(keys)), np.ones(len(keys))
        if above is not None and len(keys):
            at, _ = _find(above[0], _shorter(keys))
            done, left = above[1][at], above[2][at]
        return keys, done + left * weight * own, left * (1 - weight)


def _fit(grams: np.ndarray, counts: np.ndarray, depth: int, borders: list[np.ndarray]) -> list[tuple[_Nodes, np.ndarray]]:
    """Nodes of all depths of one range, and which of them other ranges may share."""
    out: list = [None] * (depth + 1)
    counts = counts.astype(np.float64)
    for d in range(depth, -1, -1):
        if d < depth:
            grams, at = np.unique(_shorter(grams), return_inverse=True)
            counts = np.bincount(at, weights=counts, minlength=len(grams))
        byte = grams & 0xFF
        keys, at = np.unique(np.concatenate([grams >> 8 << 8 | 1 << k | byte >> (8 - k) for k in range(8)]), return_inverse=True)
        ones = np.concatenate([counts * (byte >> (7 - k) & 1) for k in range(8)])
        n1 = np.bincount(at, weights=ones, minlength=len(keys))
        n0 = np.bincount(at, weights=np.tile(counts, 8), minlength=len(keys)) - n1
        logc = np.zeros(len(keys))
        if d < depth:
            child, shared = out[d + 1]
            logc = np.bincount(np.searchsorted(keys, _shorter(child.keys[~shared])), weights=child.logw[~shared],
                               minlength=len(keys))
        out[d] = _Nodes(keys, n0, n1, logc, d == depth), np.isin(keys >> 8, borders[d])
    return out


def _spine(rows: pa.Table, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes above borders, finished from what the ranges hold of them; by depth, see ``_Nodes.below``."""
    col = {c: rows.column(c).to_numpy() for c in ("d", "key", "n0", "n1", "logc")}
    nodes: list = [None] * depth
    for d in range(depth - 1, -1, -1):
        mine = col["d"] == d
        keys, at = np.unique(col["key"][mine], return_inverse=True)
        n0, n1, logc = (np.bincount(at, weights=col[c][mine], minlength=len(keys)) for c in ("n0", "n1", "logc"))
        if d < depth - 1:
            child = nodes[d + 1]
            logc = logc + np.bincount(np.searchsorted(keys, _shorter(child.keys)), weights=child.logw, minlength=len(keys))
        nodes[d] = _Nodes(keys, n0, n1, logc, False)
    out: list = []
    for d in range(depth):
        out.append(nodes[d].below(out[-1] if d else None))
    return out


def _gram_logs(asked: np.ndarray, fitted: list[tuple[_Nodes, np.ndarray]], spine: list, depth: int) -> np.ndarray:
    """log10 of the probability of the last byte of each gram, mixed over all depths."""
    tables, above = [], None
    for d, (nodes, shared) in enumerate(fitted):
        own = nodes.below(above, ~shared)
        if d < depth:
            order = np.argsort(keys := np.concatenate((own[0], spine[d][0])))
            own = (keys[order], *(np.concatenate((a, b))[order] for a, b in zip(own[1:], spine[d][1:])))
        tables.append(above := own)
    out, byte = np.zeros(len(asked)), asked & 0xFF
    for k in range(8):
        p = np.full(len(asked), 0.5)
        for d, (keys, done, left) in enumerate(tables):
            at, there = _find(keys, asked >> 8 * (depth + 1 - d) << 8 | 1 << k | byte >> (8 - k))
            if len(keys):  # below the deepest node that was seen, every bit is as likely as not
                p = np.where(there, done[at] + left[at] / 2, p)
        out += np.log10(np.where(byte >> (7 - k) & 1 == 1, p, 1 - p))
    return out


@dataclass
class WholeTree:
    """``logs`` (gram, c, log) of all grams of all texts, and the most frequent of them for a broadcast."""

    depth: int
    logs: DataFrame
    grams: np.ndarray
    values: np.ndarray


def fit_whole_tree(docs: DataFrame, training: Column, text: str = "text", depth: int = CT.DEPTH,
                   most: int = BROADCAST_GRAMS, range_grams: int = RANGE_GRAMS) -> WholeTree:
    """The tree of all texts where ``training`` holds, as log probabilities of every gram of all texts.

    ``most`` and ``range_grams`` bound what is broadcast and what one task fits; no result depends on them.
    """
    spark = docs.sparkSession
    learns = F.coalesce(training, F.lit(False))
    none = F.lit(0).cast("bigint")
    taught = CT.gram_counts(docs.filter(learns), text, depth).select("gram", "c", F.col("c").alias("n"))
    others = CT.gram_counts(docs.filter(~learns), text, depth).select("gram", none.alias("c"), F.col("c").alias("n"))
    counted = taught.unionByName(others).groupBy("gram").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    counts = stored(counted.withColumn("place", _backwards(F.col("gram"), depth)), "whole-tree-grams")
    bounds = _borders(counts, range_grams)
    borders = [np.unique(bounds >> 8 * (depth - d)) for d in range(depth)] + [bounds[:0]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.searchsorted(bounds, b.column("place").to_numpy() >> 8, side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, type=pa.int64())], names=[*b.schema.names, "part"])

    def fitted(table: pa.Table):
        place, c = table.column("place").to_numpy(), table.column("c").to_numpy()
        order = np.argsort(place)
        order = order[c[order] > 0]
        return _fit(place[order], c[order], depth, borders)

    def spine_rows(table: pa.Table) -> pa.Table:
        cols = [[] for _ in range(5)]
        for d, (nodes, shared) in enumerate(fitted(table)):
            for out, v in zip(cols, (np.full(shared.sum(), d), nodes.keys[shared], nodes.n0[shared], nodes.n1[shared],
                                     nodes.logc[shared])):
                out.append(v)
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(np.concatenate(v), type=k) for v, k in zip(cols, kinds)], names=["d", "key", "n0", "n1", "logc"])

    dealt = counts.mapInArrow(deal, "gram bigint, c bigint, n bigint, place bigint, part bigint")
    if len(bounds):
        spine = _spine(dealt.groupBy("part").applyInArrow(lambda t: spine_rows(t), _SPINE).toArrow(), depth)
    else:
        spine = [(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))] * depth
    shared_spine = spark.sparkContext.broadcast(spine)

    def log_rows(table: pa.Table) -> pa.Table:
        log = _gram_logs(table.column("place").to_numpy(), fitted(table), shared_spine.value, depth)
        return pa.table({"gram": table.column("gram"), "n": table.column("n"), "log": log})

    logs = stored(dealt.groupBy("part").applyInArrow(lambda t: log_rows(t), "gram bigint, n bigint, log double"), "whole-tree-logs")
    shared_spine.destroy()
    hot = _frequent(logs, most).toArrow()
    order = np.argsort(hot.column("gram").to_numpy())
    return WholeTree(depth, logs, hot.column("gram").to_numpy()[order], hot.column("log").to_numpy()[order])


def _borders(counts: DataFrame, range_grams: int) -> np.ndarray:
    """Contexts at which a new range starts."""
    parts = -(-counts.count() // range_grams)
    if parts < 2:
        return np.zeros(0, dtype=np.int64)
    at = [i / parts for i in range(1, parts)]
    found = counts.agg(F.percentile_approx("place", at, max(10_000, 20 * parts)).alias("p")).first().p
    return np.unique(np.array(found, dtype=np.int64) >> 8)


def _frequent(logs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` grams: all those found at least a power of two times, the smallest that fits."""
    sizes = {r.power: r.k for r in logs.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("k")).collect()}
    power = 0
    while sum(k for p, k in sizes.items() if p >= power) > most:
        power += 1
    return logs.filter(F.col("n") >= 1 << power).select("gram", "log")


def text_reader(tree: WholeTree, spark) -> Callable[[pa.Array], pa.Array]:
    """From binary texts to ``READ``: the summed logarithms of frequent grams, and the other grams of each whole text."""
    shared = spark.sparkContext.broadcast((tree.depth, tree.grams, tree.values))

    def read(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("score", pa.float64()), ("grams", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
        scores, others = _read([t.as_py() or b"" for t in texts], *shared.value)
        return pa.array([{"score": s, "grams": np.concatenate([g for g, _ in o]) if o else [],
                          "times": np.concatenate([k for _, k in o]) if o else []} for s, o in zip(scores, others)], type=kind)

    return read


def read_texts(text: Column, tree: WholeTree, spark) -> Column:
    """What ``text_reader`` gives, as a column."""
    of_block = text_reader(tree, spark)

    @F.arrow_udf(READ)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in text_blocks(batch):
                yield of_block(texts)

    return read(text.cast("binary"))


def _read(texts: list[bytes], depth: int, known: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, list[list]]:
    totals, others, waiting, size = np.zeros(len(texts)), [[] for _ in texts], [], 0

    def add():
        unique, at = np.unique(np.concatenate([g for _, g in waiting]), return_inverse=True)
        owners = np.repeat([i for i, _ in waiting], [len(g) for _, g in waiting])
        place, there = _find(known, unique)
        found = np.where(there, logs[place], 0.0) if len(known) else np.zeros(len(unique))
        totals[:] += np.bincount(owners, weights=found[at], minlength=len(texts))
        rest = ~there[at]
        pairs, times = np.unique(owners[rest] * len(unique) + at[rest], return_counts=True)
        starts = np.flatnonzero(np.diff(pairs // len(unique), prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(pairs)]):
            others[pairs[a] // len(unique)].append((unique[pairs[a:b] % len(unique)], times[a:b]))

    for i, text in enumerate(texts):
        padded = CT._padded(text, depth)
        for at in range(0, len(padded) - depth, CT._CHUNK):
            waiting.append((i, CT._grams(padded[at:at + CT._CHUNK + depth], depth)))
            size += len(waiting[-1][1])
            if size >= CT._MERGE:
                add()
                waiting, size = [], 0
    if waiting:
        add()
    return totals, others


def with_score(rows: DataFrame, read: str, tree: WholeTree) -> DataFrame:
    """``rows`` with ``score``, log10 of the probability of the whole text, in place of the column ``READ``.

    Rows get a number that is stored, so ids may be NULL or repeated.
    """
    text, rest = free_name(rows, "__text"), free_name(rows, "__others")
    kept = stored(rows.withColumn(text, F.monotonically_increasing_id()), "whole-tree-rows")
    others = (kept.select(text, F.inline(F.arrays_zip(F.col(f"{read}.grams").alias("gram"), F.col(f"{read}.times").alias("times"))))
              .toDF(text, "gram", "times").join(tree.logs.select("gram", "log"), "gram")
              .groupBy(text).agg(F.sum(F.col("times") * F.col("log")).alias(rest)))
    return (kept.join(others, text, "left")
            .withColumn("score", F.col(f"{read}.score") + F.coalesce(rest, F.lit(0.0))).drop(text, rest, read))
