import numpy as np
import pytest
from pyspark.sql import functions as F

from mileglass.llm import language as L
from mileglass.llm.queries import QUERIES


def plain_counts(text, features):
    out, codes = {}, ""
    for c in text.lower():
        codes += c if c.isalpha() else " " if not codes.endswith(" ") else ""
    codes = " " + codes + " "
    for k in L.ORDERS:
        for i in range(len(codes) - k + 1):
            h = 0
            for j, c in enumerate(codes[i:i + k], 1):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + j) % 2**64
            b = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - L.BUCKETS_LOG2)
            out[b] = out.get(b, 0) + 1
    return out


def test_counts(odd_texts, texts, monkeypatch):
    features = L.Features()
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(L, "_CHUNK", chunk)
        for text in [t or "" for t in odd_texts if len(t or "") < 6000] + [t[:400] for _, t in texts[:10]]:
            found = features.counts(text)
            if any(c.isalpha() for c in text.lower()):
                assert dict(zip(found[0].tolist(), found[1].tolist())) == plain_counts(text, features)
            else:
                assert found is None


def test_ftrl_separates_and_stays_sparse():
    rng = np.random.default_rng(1)
    model = L.Ftrl(50, 3, l1=0.5)
    for _ in range(600):
        y = int(rng.integers(3))
        b = np.unique(np.append(rng.integers(20, 50, 4), y))
        model.learn(b, np.ones(len(b)) / np.sqrt(len(b)), y)
    w = model.weights()
    assert all(np.argmax(w[y]) == y for y in range(3))
    assert (w == 0).mean() > 0.2


def plain_learn(rows, classes, epochs):
    """The same learning, one number at a time."""
    from math import copysign, exp, sqrt
    z, n = {}, {}
    ends = [(list(b) + [1 << L.BUCKETS_LOG2], [float(x) for x in v] + [1.0], y, f) for b, v, y, f in rows]

    def weight(key):
        a = z.get(key, 0.0)
        return -copysign(max(abs(a) - 1e-4, 0.0), a) / ((1.0 + sqrt(n.get(key, 0.0))) / 0.5 + 1e-4)
    for _ in range(epochs):
        for b, v, y, fold in ends:
            if not fold:
                continue
            w = {(i, k): weight((i, k)) for i in b for k in range(classes)}
            logits = [sum(x * w[i, k] for i, x in zip(b, v)) for k in range(classes)]
            e = [exp(x - max(logits)) for x in logits]
            for i, x in zip(b, v):
                for k in range(classes):
                    g = x * (e[k] / sum(e) - (k == y))
                    before = n.get((i, k), 0.0)
                    n[i, k] = before + g * g
                    z[i, k] = z.get((i, k), 0.0) + g - (sqrt(before + g * g) - sqrt(before)) / 0.5 * w[i, k]
    return lambda b, v: [sum(x * weight((i, k)) for i, x in zip([*b, 1 << L.BUCKETS_LOG2], [*map(float, v), 1.0])) for k in range(classes)]


def test_learning_against_plain_numbers(texts):
    features, idf = L.Features(), np.ones(1 << L.BUCKETS_LOG2)
    rows = []
    for i, (_, t) in enumerate(texts[:24]):
        b, c = features.counts(t[:60])
        rows.append((b, L.tf_idf(b, c, idf), i % 3, i % 5))
    fitted, plain = L.learn(rows, 3, 2), plain_learn(rows, 3, 2)
    for b, v, _, _ in rows:
        z = np.array(plain(b.tolist(), v))
        assert v @ fitted.weights[b] + fitted.bias == pytest.approx(z)
        p = np.exp(z / fitted.temperature) / np.exp(z / fitted.temperature).sum()
        model = L.LanguageModel(["a", "b", "c"], idf, [fitted])
        assert model.predict((b, np.exp(v / v.min() - 1)))[0] in model.languages
        assert fitted.probabilities(b, v) == pytest.approx(p)


def test_many_languages(spark):
    """250 languages, each with letters of its own; one text comes thousands of times."""
    rows = [(f"{chr(0x4e00 + 3 * g)}{chr(0x4e01 + 3 * g)} " * 3 + chr(0x4e02 + 3 * g) * (1 + k), f"l{g:03}") for g in range(250) for k in range(12)]
    rows += [rows[0]] * 5000
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    for block in (L.BLOCK, 1000):
        model = L.fit_language_model(df, rows=1000, block=block)
        assert len(model.languages) == 250 and len(model.blocks) == -(-250 // block)
        got = df.distinct().withColumn("found", L.identify(spark, F.col("text"), model)).collect()
        assert np.mean([r.found.lang == r.lang for r in got]) > 0.97
    languages, sample = L.sample_texts(df, 1000)
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    assert len(sizes) == 250 and max(sizes.values()) <= L.LEAST_ROWS
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, L.sample_texts(df.repartition(2), 1000)[1].collect()))


def test_temperature():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert L.fit_temperature(logits * 4, labels) == pytest.approx(4, rel=0.15)


def test_odd_tables(spark, odd_texts):
    docs = spark.createDataFrame([(t, "xx" if i % 2 else None) for i, t in enumerate(odd_texts)], "text string, lang string")
    for labelled in (docs, docs.filter("false"), docs.withColumn("lang", F.lit(None).cast("string"))):
        model = L.fit_language_model(labelled)
        rows = docs.withColumn("found", L.identify(spark, F.col("text"), model)).collect()
        for r in rows:
            known = model.languages and any(c.isalpha() for c in (r.text or ""))
            assert (r.found.lang, 0 < r.found.score <= 1) == (("xx", True) if known else ("und", False))


def test_held_out_accuracy(spark):
    got = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(labels, "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
