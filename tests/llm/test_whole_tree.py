import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mileglass.llm import context_tree as CT
from mileglass.llm import unigrams as W
from mileglass.llm import whole_tree as WT
from mileglass.llm.text import text_blocks
from tests.llm.test_context_tree import TEXTS, Plain


def scores(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, training boolean").repartition(3)
    tree = WT.fit_whole_tree(df, F.col("training"), **options)
    read = df.select("text", WT.read_texts(F.col("text"), tree, spark).alias("read"))
    return {r.text: r.score for r in WT.with_score(read, "read", tree).collect()}


@pytest.mark.parametrize("most, range_grams", [(0, 4), (12, 9), (10**6, 10**6)])
def test_brute_force(spark, monkeypatch, most, range_grams):
    monkeypatch.setattr(CT, "_CHUNK", 5)
    monkeypatch.setattr(CT, "_MERGE", 12)
    rows = [(t, True) for t in TEXTS] + [("zebra", False), ("bracket é", None)]
    plain = Plain(TEXTS, 2, 1)
    found = scores(spark, rows, depth=2, most=most, range_grams=range_grams)
    assert len(found) == len(rows)
    for text, s in found.items():
        assert s == pytest.approx(plain.log10(text), rel=1e-9)


def test_no_bound_changes_a_score(spark, texts, odd_texts):
    rows = [(t, i % 3 > 0) for i, (_, t) in enumerate(texts[:60])] + [(t, False) for t in odd_texts]
    whole = scores(spark, rows, range_grams=10**7)
    assert scores(spark, rows, most=100, range_grams=700) == pytest.approx(whole, rel=1e-9)
    tree = CT.fit_context_tree(spark.createDataFrame([r for r in rows if r[1]], "text string, training boolean"), max_grams=10**7)
    for text, s in whole.items():  # float32 tables there
        assert tree.score([(text or "").encode()])[0] == pytest.approx(s, rel=1e-4)


def test_query_keeps_every_context(spark):
    """The registered query gives the scores of the tree without a bound, whatever the bound of the other form."""
    from mileglass.llm.queries import QUERIES
    defaults = CT.fit_context_tree.__defaults__
    CT.fit_context_tree.__defaults__ = (*defaults[:-1], 1000)
    try:
        rows = QUERIES["op4_lm_scoring"](spark, "/root/testdata/sf0.001").collect()
    finally:
        CT.fit_context_tree.__defaults__ = defaults
    held = {r.doc_id: r.held_out for r in rows}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    tree = CT.fit_context_tree(spark.createDataFrame([(t,) for i, t in docs if not held[i]], "text string"), max_grams=10**8)
    found = {r.doc_id: r.score for r in rows}
    for i, t in docs:
        assert found[i] == pytest.approx(tree.score([(t or "").encode()])[0], rel=1e-4)


def test_no_training_texts(spark):
    assert scores(spark, [("ab", False)]) == pytest.approx({"ab": 24 * CT.np.log10(0.5)})


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_batch():
    """What a task needs does not grow with the texts that Spark hands it at once."""
    letters = np.random.default_rng(4).choice(list(b"aeinrst "), (3000, 2000)).astype(np.uint8)
    texts = [t.tobytes() for t in letters]
    known = np.unique(CT._grams(CT._padded(b"".join(texts), 5), 5))
    assert peak_mb(lambda: WT._read(texts, 5, known, np.full(len(known), -0.5))) < 70  # 244 with blocks of 1 << 22
    batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.binary())], names=["t"])
    assert peak_mb(lambda: sum(b.num_rows for b in CT._counted(iter([batch]), 5))) < 70  # 112 so


@pytest.mark.parametrize("held", [1, 15, 10**6])
def test_counts_of_a_task(monkeypatch, held):
    monkeypatch.setattr(CT, "_CHUNK", 5)
    monkeypatch.setattr(CT, "_MERGE", 12)
    monkeypatch.setattr(CT, "_ROWS", 7)
    monkeypatch.setattr(CT, "_HELD", held)
    texts = [None, "", "a", "abracadabra " * 9, "zebra", "abracadabra"]
    found, rows = Counter(), 0
    for b in CT._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts, type=pa.binary())], names=["t"])]), 2):
        rows += b.num_rows
        found.update(dict(zip(b.column("gram").to_pylist(), b.column("c").to_pylist())))
    want = Counter(g for t in texts for g in CT._grams(CT._padded((t or "").encode(), 2), 2).tolist())
    assert found == want and (rows > len(want)) == (held < 10**6)


def test_text_blocks():
    texts = [None, "", "abc", "x" * 50, "", "abcdefgh", None, "é"]
    for most in (1, 4, 9, 10**6):
        blocks = [b.to_pylist() for b in text_blocks(pa.array(texts), most)]
        assert [t for b in blocks for t in b] == texts and all(blocks)
        assert all(sum(len((t or "").encode()) for t in b[1:]) < most for b in blocks)
    assert len(blocks) == 1 and not list(text_blocks(pa.array([], type=pa.string())))


def test_both_scores_from_one_reading(spark, odd_texts):
    """The query's two scores share a Python process, and are those of the operators on their own."""
    rows = [(t, i % 3 > 0) for i, t in enumerate(odd_texts + ["abracadabra", "zebra zebra"])]
    df = spark.createDataFrame(rows, "text string, training boolean").repartition(3)
    tree = WT.fit_whole_tree(df, F.col("training"), depth=2, most=12)
    both = W.unigram_scores(df, F.col("training"), keep={"text": F.col("text")}, most=3,
                            beside={"read": (WT.READ, WT.text_reader(tree, spark))})
    found = {r.text: (r.score, r.n_tokens, r.n_known, r.base_score) for r in WT.with_score(both, "read", tree).collect()}
    whole = scores(spark, rows, depth=2)
    plain = W.unigram_scores(df, F.col("training"), keep={"text": F.col("text")}).collect()
    assert len(found) == len(plain) == len(rows)
    for r in plain:
        assert found[r.text] == pytest.approx((whole[r.text], r.n_tokens, r.n_known, r.base_score), rel=1e-9)
