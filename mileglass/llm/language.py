"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, then calibrated by a temperature.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mileglass.llm.text import stored

ORDERS = (1, 2, 3)
BUCKETS_LOG2 = 15
#: Labelled texts that the weights and the temperature are fitted on, over all languages, and for each language at
#: least: the bound of the sample.
SAMPLE_ROWS, LEAST_ROWS = 4000, 10
#: Languages that are told apart by one task.  More of them are learned in blocks of this size: one model tells the
#: blocks apart, one for each block its languages.
BLOCK = 128
UNKNOWN = "und"
_CHUNK = 1 << 20


class Features:
    """Counts of hashed character n-grams; letters in lower case, everything else one kind of gap."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, buckets_log2: int = BUCKETS_LOG2):
        self.orders, self.log2, self.size = orders, buckets_log2, 1 << buckets_log2
        self.letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool)

    def codes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        codes = np.where(self.letter[codes], codes, np.uint32(32))
        gap = codes == 32
        return codes[np.append(True, ~(gap[1:] & gap[:-1]))] if len(codes) else codes

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(buckets, counts) of a whole text, or None if it has no letter."""
        codes = self.codes(text)
        if not (codes != 32).any():
            return None
        total = np.zeros(self.size, dtype=np.int64)
        most = max(self.orders)
        padded = np.concatenate(([32], codes, [32])).astype(np.uint64)
        for at in range(0, len(padded), _CHUNK):
            part = padded[at:at + _CHUNK + most - 1]
            n = min(_CHUNK, len(padded) - at)
            h = np.zeros(len(part), dtype=np.uint64)
            for k in range(1, most + 1):
                m = len(part) - k + 1
                if m <= 0:
                    break
                h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + part[k - 1:k - 1 + m] + np.uint64(k)
                if k in self.orders:
                    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    total += np.bincount((mixed[:n] >> np.uint64(64 - self.log2)).astype(np.int64), minlength=self.size)
        buckets = np.flatnonzero(total)
        return buckets, total[buckets]


@dataclass
class Weights:
    """Weights (buckets by classes), intercepts and the temperature of one multinomial model."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
        return _softmax((values @ self.weights[buckets] + self.bias) / self.temperature)


@dataclass
class LanguageModel:
    """Languages, inverse document frequencies, and the models of the blocks of languages.

    ``root`` tells the blocks apart; it is not needed for one block.
    """

    languages: list[str]
    idf: np.ndarray
    blocks: list[Weights]
    root: Weights | None = None

    def predict(self, found: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, float]:
        """The likeliest language; the probability of a language is that of its block times its own within it."""
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        values = tf_idf(*found, self.idf)
        p = [b.probabilities(found[0], values) for b in self.blocks]
        if self.root is not None:
            p = [share * q for share, q in zip(self.root.probabilities(found[0], values), p)]
        p = np.concatenate(p)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def tf_idf(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf, at length one."""
    v = (1 + np.log(counts)) * idf[buckets]
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader per coordinate, with penalties on absolute values and squares."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4,
                 l2: float = 1e-4):
        self.z = np.zeros((features + 1, classes))  # the last row is the intercept
        self.n = np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        rows, x = np.append(buckets, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(rows)
        p = _softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        sigma = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / self.alpha
        self.z[rows] += g - sigma * w
        self.n[rows] += g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Texts with a letter, and in how many of them each bucket occurs, over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        seen, n = np.zeros(features.size, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                found = features.counts(t.as_py() or "")
                if found is not None:
                    seen[found[0]] += 1
                    n += 1
        buckets = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(buckets, -1)), pa.array(np.append(seen[buckets], n))],
                                         names=["bucket", "n"])

    rows = (texts.select(text).mapInArrow(count, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())  # at most one row for each bucket
    df, n = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64), 0
    for bucket, k in zip(rows.column("bucket").to_pylist(), rows.column("n").to_pylist()):
        if bucket < 0:
            n = k
        else:
            df[bucket] = k
    return n, df


def sample_texts(labelled: DataFrame, rows: int) -> tuple[list[str], DataFrame]:
    """All languages, sorted, and a sample of distinct texts with the place of their language.

    Every language gets the same share of ``rows``, but ``LEAST_ROWS`` at least, of its distinct texts: those with
    the smallest hashes among the ones drawn, so the sample does not depend on copies, partitions or order.
    """
    spark = labelled.sparkSession
    found = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()  # one row a language
    sizes = {r.lang: r.n for r in found}
    languages = sorted(sizes)
    quota = max(rows // max(len(languages), 1), LEAST_ROWS)
    # Twice the quota is drawn; then its first rows by hash are taken.
    shares = spark.createDataFrame([(g, i, min(1.0, 2 * quota / sizes[g])) for i, g in enumerate(languages)],
                                   "lang string, label int, share double")
    draw = F.pmod(F.xxhash64("text", F.lit(8)), F.lit(1_000_000)) / 1_000_000
    turn = F.xxhash64("text", F.lit(10))
    first = Window.partitionBy("label").orderBy("turn", "text")
    drawn = labelled.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("label", "text").distinct()
    return languages, (drawn.withColumn("turn", turn).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= quota)
                       .select("label", "text", "turn", F.pmod(F.xxhash64("text", F.lit(9)), F.lit(5)).alias("fold")))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int, int]], classes: int, epochs: int) -> Weights:
    """Weights from rows of (buckets, values, label, fold) in their order; fold 0 teaches the temperature alone."""
    model = Ftrl(1 << BUCKETS_LOG2, classes)
    for _ in range(epochs):
        for buckets, values, label, fold in rows:
            if fold:
                model.learn(buckets, values, label)
    w = model.weights()
    tuned = [(v @ w[b] + w[-1], label) for b, v, label, fold in rows if not fold]
    return Weights(w[:-1], w[-1], fit_temperature(np.array([z for z, _ in tuned]), np.array([y for _, y in tuned], dtype=np.int64)))


def fit_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS,
                       block: int = BLOCK, epochs: int = 3) -> LanguageModel:
    """Learn every language from rows with a text and a language.

    Document frequencies come from all labelled texts.  The weights are fitted on a sample bounded by ``rows`` in
    all, or by ``LEAST_ROWS`` for each language if that is more (see ``sample_texts``): four fifths teach the weights,
    one fifth the temperature.  Each block of languages is one task's work; only weights come to the driver, whose
    size depends on the number of languages alone.  Rows whose text or language is NULL teach nothing.  Without any
    other row every answer is ``und``.
    """
    spark = labelled.sparkSession
    labelled = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    languages, sample = sample_texts(labelled, rows)
    if not languages:
        return LanguageModel([], np.ones(1 << BUCKETS_LOG2), [])
    n, df = document_frequencies(labelled, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    shared = spark.sparkContext.broadcast(idf)

    @F.arrow_udf("struct<buckets:array<int>,values:array<float>>")
    def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, weights = Features(), shared.value
        kind = pa.struct([("buckets", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
        for texts in batches:
            found = [features.counts(t.as_py()) for t in texts]
            yield pa.array([None if f is None else {"buckets": f[0], "values": tf_idf(*f, weights)} for f in found], type=kind)

    blocks = -(-len(languages) // block)

    def train(table: pa.Table) -> pa.Table:
        model = table.column("model")[0].as_py()
        classes = blocks if model < 0 else min(block, len(languages) - model * block)
        # By a hash of the text: an order that does not depend on how the rows arrived.
        taught = sorted(zip(*(table.column(c).to_pylist() for c in ("turn", "label", "vector", "fold"))), key=lambda r: r[:2])
        found = learn([(np.array(v["buckets"], dtype=np.int64), np.array(v["values"]),
                        label // block if model < 0 else label - model * block, fold) for _, label, v, fold in taught], classes, epochs)
        packed = np.vstack([found.weights, found.bias]).astype("<f4").tobytes()
        return pa.table({"model": pa.array([model], pa.int32()), "weights": [packed], "temperature": [found.temperature]})

    vectors = stored(sample.withColumn("vector", vector(F.col("text"))).drop("text").filter("vector is not null"), "language-sample")
    own = F.floor(F.col("label") / block).cast("int")
    models = F.array(own) if blocks == 1 else F.array(F.lit(-1), own)
    fitted = {r.model: r for r in vectors.withColumn("model", F.explode(models)).groupBy("model")
              .applyInArrow(lambda t: train(t), "model int, weights binary, temperature double").collect()}
    if not fitted:
        return LanguageModel([], idf, [])

    def weights(model: int, classes: int) -> Weights:
        if model not in fitted:  # no text of these languages has a letter: none is likelier than another
            return Weights(np.zeros((len(idf), classes)), np.zeros(classes), 1.0)
        w = np.frombuffer(fitted[model].weights, dtype="<f4").reshape(-1, classes).astype(np.float64)
        return Weights(w[:-1], w[-1], fitted[model].temperature)

    return LanguageModel(languages, idf, [weights(b, min(block, len(languages) - b * block)) for b in range(blocks)],
                         weights(-1, blocks) if blocks > 1 else None)


def identify(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """struct(lang, score): the likeliest learned language of a whole text and its calibrated probability.

    ``und`` with score 0 for NULL texts and texts without a letter, and if no language was learned.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, fitted = Features(), shared.value
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
        for texts in batches:
            out = [fitted.predict(features.counts(t.as_py() or "")) for t in texts]
            yield pa.array([{"lang": g, "score": s} for g, s in out], type=kind)

    return predict(text)
