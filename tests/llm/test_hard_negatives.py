import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mileglass.llm import hard_negatives as H
from mileglass.llm.queries import ORACLES, QUERIES
from tests import oracle

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=3, positives=5, negatives=5):
    """Rows as (id, vector, label); anchors have an id that is divisible by ``every``."""
    clean = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows
             if None not in (i, v, g) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, g in sorted({(i, tuple(v), g) for i, v, g in clean if i % every == 0}):
        scored = [(-sum(x * y for x, y in zip(v, w)), i, h) for i, w, h in clean]
        for p, i, _ in sorted(x for x in scored if x[2] == g and x[1] != a)[:positives]:
            fits = sorted(x for x in scored if x[2] != g and 80 * -p <= 100 * -x[0] <= 100 * -p)
            out += [(a, i, r, n, -p, -s) for r, (s, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(df, **options):
    out = H.mine_hard_negatives(df, F.col("vec_id") % 3 == 0, **options)
    return sorted(tuple(r) for r in out.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(1, 6), st.integers(0, 2**32 - 1))
def test_strassen(m, k, n, leaf, seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(-1000, 1000, (m, k)), r.integers(-1000, 1000, (k, n))
    assert (H.strassen(a, b, leaf) == a @ b).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-3, 3), st.booleans()), min_size=6, max_size=6), min_size=1, max_size=6))
def test_heaps_merge(offers):
    heap, seen = H.Heaps(1, 3), []
    for t, row in enumerate(offers):
        ids = np.array([(17 * (t * 6 + i)) % 37 for i in range(6)])
        heap.offer(np.array([[s for s, _ in row]]), ids, np.array([[ok for _, ok in row]]))
        seen += [(-s, i) for (s, ok), i in zip(row, ids.tolist()) if ok]
    _, scores, ids = heap.entries()
    assert list(zip((-scores).tolist(), ids.tolist())) == sorted(seen)[:3]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    base = [(i, [float(x) for x in r.choice([-0.25, 0.0, 0.25, 0.5, 0.30001], 5)], int(r.integers(0, 3))) for i in range(120)]
    odd = [(None, [0.5] * 5, 1), (201, None, 1), (202, [0.5, None, 0.5, 0.5, 0.5], 1), (203, [float("nan")] * 5, 2), (204, [0.5] * 5, None),
           (205, [float("inf"), 0.0, 0.0, 0.0, 0.0], 0), (206, [0.5, 0.5], 1), (207, [], 2), (207, [], 2), (9, [0.5] * 5, 2), (9, [0.5] * 5, 2)]
    return base + odd


def test_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert want and mined(df) == want
    monkeypatch.setattr(H, "ROW_TILE", 7)
    monkeypatch.setattr(H, "ANCHOR_TILE", 4)
    assert mined(df, block_bytes=400) == want  # many blocks of few anchors, many small tiles


def test_hot_label_and_equal_vectors(spark):
    rows = [(i, [0.5, 0.25], 1 if i % 3 else 0) for i in range(60)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == [] and mined(spark.createDataFrame([(1, [0.5], 1)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(3, [0.5], 1)], SCHEMA)) == []
    named = spark.createDataFrame([(3, [0.5], 1, 1, 2, 3), (4, [0.5], 1, 1, 2, 3), (5, [0.45], 2, 1, 2, 3)],
                                  SCHEMA + ", anchor int, id int, rank int")
    assert mined(named) == [(3, 4, 1, 5, 128 * 128, 115 * 128)]


def test_query(spark, sf_dir):
    got = oracle.spark_result(QUERIES["op13_hard_negatives"](spark, sf_dir))
    assert got[1] and oracle.difference(got, oracle.duck_result(oracle.connect(sf_dir), ORACLES["op13_hard_negatives"])) is None
