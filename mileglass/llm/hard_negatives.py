"""Hard negatives of anchors: exact integer scores by Strassen's multiplication, kept in mergeable heaps.

Anchors are a stated query set.  They are taken in blocks of a fixed size; each block is broadcast and meets every row
tile by tile, so no pair of rows is ever written.  A task keeps one short heap for each anchor of the block; heaps of
different tasks merge into one by taking the first entries of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mileglass.llm.text import stored
from mileglass.session import run_dir

#: Side of the matrices that are multiplied plainly.
LEAF = 32
#: Rows of a tile, anchors and candidates.
ANCHOR_TILE, ROW_TILE = 512, 1024
#: Bytes of the anchors that are broadcast at once.
BLOCK_BYTES = 8 << 20
_LEAST = np.iinfo(np.int64).min
_LARGEST = float(1 << 62)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven half-size products; odd sides are padded with zeros.

    Only additions and products of integers, so the result is exact modulo 2**64.
    """
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * h, 2 * j), dtype=np.int64)
    c[:h, :j] = p1 + p4 - p5 + p7
    c[:h, j:] = p3 + p5
    c[h:, :j] = p2 + p4
    c[h:, j:] = p1 - p2 + p3 + p6
    return c[:m, :n]


class Heaps:
    """The first ``k`` entries of many heaps: higher scores first, smaller ids among equal scores."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), _LEAST, dtype=np.int64)
        self.ids = np.zeros((n, k), dtype=np.int64)
        self.filled = np.zeros(n, dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Offer one row of ``scores`` to each heap; ``ids`` go with the columns, ``allowed`` says which count."""
        k = self.scores.shape[1]
        open_ = allowed & (scores >= self.scores[:, -1:])  # an unfilled heap has the least score at its end
        if open_.sum() > 4 * self.scores.size and scores.shape[1] > k:
            # Only what reaches the k-th best of the tile can get in; ties with it stay.
            best = np.partition(np.where(open_, scores, _LEAST), -k, axis=1)[:, -k]
            open_ &= scores >= best[:, None]
        rows, cols = np.nonzero(open_)
        if not len(rows):
            return
        touched = np.unique(rows)
        old_rows, old_cols = np.nonzero(np.arange(k) < self.filled[touched, None])
        old_rows = touched[old_rows]
        row = np.concatenate([rows, old_rows])
        score = np.concatenate([scores[rows, cols], self.scores[old_rows, old_cols]])
        entry = np.concatenate([ids[cols], self.ids[old_rows, old_cols]])
        order = np.lexsort((entry, ~score, row))  # ~score falls as the score rises, without overflow
        row, score, entry = row[order], score[order], entry[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        row, place = row[keep], place[keep]
        self.scores[row, place], self.ids[row, place] = score[keep], entry[keep]
        self.filled[touched] = np.bincount(row, minlength=len(self.filled))[touched]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(heap, score, id) of all entries."""
        rows, cols = np.nonzero(np.arange(self.scores.shape[1]) < self.filled[:, None])
        return rows, self.scores[rows, cols], self.ids[rows, cols]


def tiles(batch: pa.RecordBatch, width: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, int64 matrix) of a batch with columns id, label and vector, in tiles of rows.

    A component x becomes floor(scale * x).  Rows with a NULL or non-finite component are left out; shorter vectors
    count as padded with zeros, and components beyond ``width`` meet zeros only.
    """
    vectors = batch.column(2)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)  # NULL becomes NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = np.bincount(row, weights=~np.isfinite(values), minlength=len(lengths)) == 0
    inside = (place < width) & good[row]
    matrix = np.zeros((len(lengths), width), dtype=np.int64)
    matrix[row[inside], place[inside]] = np.clip(np.floor(values[inside] * scale), -_LARGEST, _LARGEST).astype(np.int64)
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[good] for c in (0, 1))
    matrix = matrix[good]
    for at in range(0, len(ids), ROW_TILE):
        part = slice(at, at + ROW_TILE)
        yield ids[part], labels[part], matrix[part]


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Merge the heaps of all tasks: the first ``k`` entries for each of ``keys``, with their ``rank`` from 1.

    The rank limit is applied within each task before the shuffle as well.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, anchors: Column, id: str = "vec_id", label: str = "label",
                        vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5,
                        percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives that score just below the positive.

    ``anchors`` is a condition on the rows.  A score is the inner product of the floored, scaled vectors; higher
    scores come first, ties by smaller id.  Positives are the first other rows (by id) of the anchor's label.
    Negatives are rows of another label with ``percent * positive <= 100 * negative <= 100 * positive``, so a
    positive with a score below zero has none.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a NULL id, label or vector, or a NULL or non-finite component take no part.  Repeated rows count each,
    as candidates; as anchors equal rows are one.  Vectors of different lengths are padded with zeros.  Scores are
    exact if they fit a long.  Empty tables give no rows.

    Work is anchors times rows, without a shuffle of rows: every block of anchors is one pass over them.  What is
    shuffled is a heap of ``positives`` (or their product with ``negatives``) entries for each anchor and task.
    """
    spark = rows.sparkSession
    data = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).cast("array<double>").alias("vector"), anchors.alias("anchor")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    sound = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chosen = stored(data.filter(F.col("anchor") & sound).select("id", "label", "vector").distinct()
                    .withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n, width = chosen.agg(F.count("*"), F.max(F.size("vector"))).first()
    base = run_dir(spark, "hard-negatives")
    blocks = -(-n * max(width or 1, 1) * 8 // block_bytes)
    data = data.select("id", "label", "vector")
    for block in range(blocks):
        mine = chosen.filter(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block).orderBy("anchor").toArrow()
        _mine_block(data, mine, width, scale, positives, negatives, percent, base, block)
    if not blocks:
        return spark.createDataFrame([], _RESULT)
    return spark.read.schema(_RESULT).parquet(*[f"{base}/negatives-{b}" for b in range(blocks)])


_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _mine_block(data: DataFrame, mine: pa.Table, width: int, scale: int, positives: int, negatives: int, percent: int,
                base: str, block: int) -> None:
    """Both passes for one block of anchors; the result is written below ``base``."""
    spark = data.sparkSession
    if not mine.num_rows:
        spark.createDataFrame([], _RESULT).write.parquet(f"{base}/negatives-{block}")
        return
    batch = mine.select(["id", "label", "vector"]).combine_chunks().to_batches()[0]
    parts = list(tiles(batch, width, scale))
    ids, labels, matrix = (np.concatenate([p[i] for p in parts]) for i in range(3))
    shared = spark.sparkContext.broadcast((ids, labels, matrix))

    def score_tiles(batches):
        """For each tile of anchors and each tile of rows: the anchors' slice, row ids, row labels and scores."""
        _, _, vectors = shared.value
        for b in batches:
            for row_ids, row_labels, candidates in tiles(b, width, scale):
                for at in range(0, len(vectors), ANCHOR_TILE):
                    part = slice(at, at + ANCHOR_TILE)
                    yield part, row_ids, row_labels, strassen(vectors[part], candidates.T)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_labels, _ = shared.value
        heaps = {at: Heaps(len(own[at:at + ANCHOR_TILE]), positives) for at in range(0, len(own), ANCHOR_TILE)}
        for part, row_ids, row_labels, scores in score_tiles(batches):
            same = (own_labels[part, None] == row_labels) & (own[part, None] != row_ids)
            heaps[part.start].offer(scores, row_ids, same)
        for at, heap in heaps.items():
            anchor, score, entry = heap.entries()
            yield pa.RecordBatch.from_arrays([pa.array(anchor + at), pa.array(score), pa.array(entry)], ["anchor", "score", "id"])

    found = data.mapInArrow(nearest, "anchor long, score long, id long")
    best = _first(found, ["anchor"], positives).orderBy("anchor", "rank").toArrow()  # a few for each anchor of the block
    anchor, top, positive = (best.column(c).to_numpy() for c in ("anchor", "score", "id"))
    windows = spark.sparkContext.broadcast((anchor, top, positive, -(-percent * top.astype(object) // 100)))

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, own_labels, _ = shared.value
        of, high, _, low = windows.value
        low = low.astype(np.int64)
        heaps = {}
        for part, row_ids, row_labels, scores in score_tiles(batches):
            # The windows of these anchors; a window that is empty takes nothing.
            wins = np.flatnonzero((of >= part.start) & (of < part.stop) & (low <= high))
            if not len(wins):
                continue
            if part.start not in heaps:
                heaps[part.start] = wins, Heaps(len(wins), negatives)
            at = of[wins] - part.start
            mine = scores[at]
            fits = (own_labels[of[wins], None] != row_labels) & (mine <= high[wins, None]) & (mine >= low[wins, None])
            heaps[part.start][1].offer(mine, row_ids, fits)
        for wins, heap in heaps.values():
            number, score, entry = heap.entries()
            yield pa.RecordBatch.from_arrays([pa.array(wins[number]), pa.array(score), pa.array(entry)], ["window", "score", "id"])

    merged = _first(data.mapInArrow(windowed, "window long, score long, id long"), ["window"], negatives)
    names = pa.table({"window": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": top})
    named = spark.createDataFrame(names) if len(anchor) else spark.createDataFrame(
        [], "window long, anchor_id long, positive_id long, positive_score long")
    (merged.join(F.broadcast(named), "window")  # as many rows as the block has windows
     .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
             "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{base}/negatives-{block}"))
    windows.destroy()
    shared.destroy()
