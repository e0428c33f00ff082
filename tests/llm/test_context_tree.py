import zlib
from collections import Counter
from fractions import Fraction
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from mileglass.llm import context_tree as CT
from mileglass.llm import unigrams as W
from mileglass.llm.queries import QUERIES

TEXTS = ["abracadabra", "abba", "", "éa", "aaaa b", None, "abra"]


def kt(n0, n1):
    p = Fraction(1)
    for i in range(n0):
        p *= Fraction(2 * i + 1, 2)
    for i in range(n1):
        p *= Fraction(2 * i + 1, 2)
    for i in range(n0 + n1):
        p /= i + 1
    return p


class Plain:
    """Context-tree weighting from its definition: the ratio of block probabilities with and without one more bit."""

    def __init__(self, texts, depth, least):
        self.depth, self.seen = depth, []
        for t in texts:
            b = b"\xff" * depth + (t or "").encode() + b"\xff"
            self.seen += [(b[i - depth:i], b[i]) for i in range(depth, len(b))]
        n = Counter(c[len(c) - d:] for c, _ in self.seen for d in range(1, depth + 1))
        self.held = {c for c, k in n.items() if k >= least}

    def block(self, context, bits):
        """Weighted probability of bits (context, bit) below a context."""
        ones = sum(b for _, b in bits)
        own = kt(len(bits) - ones, ones)
        d = len(context)
        if d == self.depth:
            return own
        parts = {}
        for c, b in bits:
            child = c[len(c) - d - 1:]
            parts.setdefault(child if child in self.held else None, []).append((c, b))
        deeper = Fraction(1)
        for child, rows in parts.items():
            ones = sum(b for _, b in rows)
            deeper *= kt(len(rows) - ones, ones) if child is None else self.block(child, rows)
        return (own + deeper) / 2

    def log10(self, text):
        b, total = b"\xff" * self.depth + (text or "").encode() + b"\xff", 0.0
        for i in range(self.depth, len(b)):
            for k in range(8):
                rows = [(c, x >> (7 - k) & 1) for c, x in self.seen if (x ^ b[i]) >> (8 - k) == 0]
                more = rows + [(b[i - self.depth:i], b[i] >> (7 - k) & 1)]
                total += log10(self.block(b"", more) / self.block(b"", rows))
        return total


@pytest.mark.parametrize("max_grams", [10**6, 25])
def test_brute_force(spark, max_grams):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    tree = CT.fit_context_tree(df, depth=2, max_grams=max_grams)
    least = CT._least_count(CT._levels(CT.gram_counts(df, "text", 2), 2), max_grams)
    assert (least > 1) == (max_grams == 25)
    plain = Plain(TEXTS, 2, least)
    scored = {r.text: r.s for r in df.union(spark.createDataFrame([("zebra",), ("bracket é",)], "text string"))
              .withColumn("s", CT.score_texts(F.col("text"), tree, spark)).collect()}
    for text, s in scored.items():
        assert s == pytest.approx(plain.log10(text), rel=1e-5)


def test_probabilities_of_all_bytes_sum_to_one(spark, texts):
    tree = CT.fit_context_tree(spark.createDataFrame(texts[:60], "doc_id long, text string"), max_grams=4000)
    for context in (b"\xff" * 5, b"d the", b"zzzzz"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.int64)
        assert (10 ** tree.mixed_logs(grams)).sum() == pytest.approx(1, abs=1e-5)


def test_no_training_texts(spark):
    tree = CT.fit_context_tree(spark.createDataFrame([], "text string"))
    assert tree.score([b"ab", b""]) == pytest.approx([24 * log10(0.5), 8 * log10(0.5)])
    assert tree.score([]).tolist() == []


def test_blocks_and_parts_change_no_score(spark, texts, monkeypatch):
    tree = CT.fit_context_tree(spark.createDataFrame(texts[:20], "doc_id long, text string"), max_grams=2000)
    given = [t.encode() for _, t in texts[:40]] + [b"", b"zq" * 500]
    whole = tree.score(given)
    monkeypatch.setattr(CT, "_CHUNK", 50)
    monkeypatch.setattr(CT, "_MERGE", 120)
    assert tree.score(given) == pytest.approx(whole, rel=1e-12)


def test_log_kt():
    for a, b in ((0, 0), (1, 0), (3, 5), (40, 2)):
        assert CT.log_kt(np.array([a]), np.array([b]))[0] / np.log(10) == pytest.approx(
            log10(kt(a, b)) if a + b else 0, abs=1e-9)


def plain_unigrams(docs, training):
    def tokens(t):
        return [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in docs if training(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
             sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in docs]


@pytest.mark.parametrize("most", [0, 30, 10**6])
def test_unigrams(spark, texts, odd_texts, most):
    docs = texts[:50] + [(1000 + i, t) for i, t in enumerate(odd_texts)] + [(7, "the the new"), (None, "the end")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = W.unigram_scores(df, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), most=most).collect()
    want = plain_unigrams(docs, lambda i: i is not None and i % 3 == 0)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for got, exp in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert got[:4] == exp[:4] and got[4] == pytest.approx(exp[4], rel=1e-9)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = {r.doc_id: r for r in QUERIES["op4_lm_scoring"](spark, "/root/testdata/sf0.001").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    assert len(rows) == len(docs)
    for i, n, known, total, base in plain_unigrams(docs, lambda i: not held[i]):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    for group in (True, False):  # far below the eight bits of a byte that tells nothing, also on texts never seen
        assert np.mean([r.bits_per_byte for r in rows.values() if r.held_out == group and r.n_tokens > 20]) < 3.2


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b rare", "r", "s", 5)], "doc_id long, text string, __row string, __seen string, n_tokens int")
    plain = W.unigram_scores(df.select("doc_id", "text"), F.lit(True), most=0).first()
    r = W.unigram_scores(df, F.lit(True), most=0).first()
    assert (r["doc_id"], r["__row"], r["__seen"], r["n_tokens"], r["n_known"], r["base_score"]) == (1, "r", "s", 4, plain.n_known, plain.base_score)
