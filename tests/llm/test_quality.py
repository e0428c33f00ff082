import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mileglass.llm import quality as Q
from mileglass.llm.queries import QUERIES

BLANK = r"[^\x20\x09-\x0D]+"


def measures(text):
    text = text or ""
    w = re.findall(BLANK, text)
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, texts, odd_texts):
    more = ["a b c a b c", "a b c a b c a", "x x x x x", "x x x", "x\ny\nx\n \n \nx", "# * $%&|<>é", "a a\x1cb a a\x1cb a",
            "one two three four one two three"]
    docs = [t for _, t in texts] + odd_texts + more
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for r in Q.with_measures(df).collect():
        assert tuple(r.measures[c] for c in Q.MEASURES[:5]) == measures(r.text), r.text


def plain_em(patterns, catches, prior=0.85, weight=0.05, rounds=30, tolerance=1e-4):
    total = sum(patterns.values())
    pseudo = max(1.0, weight * total)
    start = (prior, [0.01] * len(catches), list(catches))
    model = start

    def good(votes, m):
        odds = math.log((1 - m[0]) / m[0])
        for v, g, b in zip(votes, m[1], m[2]):
            odds += math.log(b / g) if v == -1 else math.log((1 - b) / (1 - g)) if v == 1 else 0
        return 1 / (1 + math.exp(odds))
    for _ in range(rounds):
        sides = []
        for side in (0, 1):
            share = {p: n * (good(p, model) if side == 0 else 1 - good(p, model)) for p, n in patterns.items()}
            sides.append((sum(share.values()), [
                (sum(x for p, x in share.items() if p[i] == -1) + pseudo * start[side + 1][i])
                / (sum(x for p, x in share.items() if p[i]) + pseudo) for i in range(len(catches))]))
        new = ((sides[0][0] + pseudo * prior) / (total + pseudo), sides[0][1], sides[1][1])
        moved = max(abs(a - b) for a, b in zip([new[0], *new[1], *new[2]], [model[0], *model[1], *model[2]]))
        model = new
        if moved < tolerance:
            break
    return model, lambda votes: good(votes, model)


def test_votes_against_plain_em(spark, texts):
    rules = Q.default_rules()
    measured = Q.with_measures(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    votes = measured.select("doc_id", *[Q.vote(r).alias(r.name) for r in rules])
    rows = {r.doc_id: tuple(r)[1:] for r in votes.collect()}
    model = Q.fit_votes(votes.drop("doc_id"), rules)
    (prior, good, bad), posterior = plain_em(Counter(rows.values()), [r.catches for r in rules])
    assert model.prior == pytest.approx(prior) and model.against_good == pytest.approx(good) and model.against_bad == pytest.approx(bad)
    for r in Q.judge_quality(measured, model, rules).collect():
        assert r.quality == pytest.approx(posterior(rows[r.doc_id]))
        m = measures(r.text)
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_clashing_names_nulls_and_empty_tables(spark):
    rows = [(1, "word " * 60, "x", 1.0), (None, None, None, None), (1, "word " * 60, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, measures string, quality double")
    kept = Q.keep_quality(df)
    assert kept.columns == df.columns and kept.count() == 0
    prose = "".join(f"{chr(97 + i % 26)}ome thing{i} is like{i * i} nothing{3 * i}.\n" for i in range(40))
    assert Q.keep_quality(spark.createDataFrame([(1, prose, "m", None)] * 2, df.schema)).count() == 2
    assert Q.keep_quality(df.limit(0)).count() == 0
    inner = spark.createDataFrame([("a b", "w", "l", "h", "o")], "text string, __words string, __Lines string, __hashes string, __ordered string")
    for out in (Q.with_measures(inner), Q.score_quality(inner)):
        r = out.first()
        assert tuple(r)[:5] == ("a b", "w", "l", "h", "o") and r.measures.n_words == 2


def test_no_python_in_the_plan(spark, texts):
    plan = Q.keep_quality(spark.createDataFrame(texts, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert "transform(" not in plan  # judging reads the stored measures


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = (QUERIES["op7_quality_rules"](spark, sf).withColumnRenamed("quality", "posterior")
            .join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect())
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
