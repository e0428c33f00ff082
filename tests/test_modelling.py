"""Folds, model scores and profiles of typed columns."""

import datetime
import decimal

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from mileglass.operators import modelling as D
from mileglass.operators import preparation as P
from mileglass.operators import profiling as R
from mileglass.plans.profile_queries import MODEL_FEATURES
from mileglass.sources.adapters import scored_labels


def test_folds_are_stratified(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(0).alias("y"))
    folds = D.with_folds(df, "y", "id").cache()
    sizes = {(r.y, r.fold): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    for y in (0, 1, None):
        of = [n for (v, _), n in sizes.items() if v == y]
        assert len(of) == 5 and max(of) - min(of) <= 1
    again = D.with_folds(df.repartition(7).withColumn("extra", F.lit(1)), "y", "id").drop("extra")
    assert sorted(map(tuple, again.select("id", "fold").collect())) == sorted(map(tuple, folds.select("id", "fold").collect()))
    keyless = D.with_folds(df.withColumn("id", F.lit(None).cast("long")), "y", "id")
    assert {r.fold for r in keyless.select("fold").distinct().collect()} == {0}


def test_models_beat_chance(spark, sf_dir):
    df = P.class_weights(D.with_folds(scored_labels(spark, sf_dir), "target", "doc_id"), "target").cache()
    # A target that the features tell: what the models are worth, not whether the given labels can be learned.
    df = df.withColumn("target", (F.col("n_chars") > df.approxQuantile("n_chars", [0.5], 0.0)[0]).cast("int"))
    scores = D.cross_validate(df, **MODEL_FEATURES)
    assert list(scores) == ["logistic_regression", "random_forest", "gradient_boosted_trees"]
    assert all(0.9 < v <= 1 for v in scores.values())


def test_cross_validation_encodes_each_fold_once(spark, monkeypatch):
    rows = [(i, float(i % 10), float((7 * i) % 5), "u" if i % 3 else "v", int(i % 10 + i % 4 >= 6)) for i in range(300)]
    df = D.with_folds(spark.createDataFrame(rows, "id int, a double, b double, c string, y int"), "y", "id", folds=3).cache()
    fitted = []
    plain = StringIndexer._fit
    monkeypatch.setattr(StringIndexer, "_fit", lambda self, data: fitted.append(1) or plain(self, data))
    scores = D.cross_validate(df, "y", ["a", "b"], ["c"], folds=3)
    assert len(fitted) == 3
    for name, e in D.estimators("y", None).items():
        run = CrossValidator(estimator=D.pipeline(e, ["a", "b"], ["c"]), numFolds=3, foldCol="fold",
                             estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="y"))
        assert scores[name] == pytest.approx(run.fit(df).avgMetrics[0], abs=0.01), name
    with pytest.raises(ValueError, match="validation data at fold 3"):
        D.cross_validate(df, "y", ["a", "b"], ["c"], folds=4)


def test_curve_and_importance(spark):
    rows = [(float(i % 10), float((7 * i) % 5), "u" if i % 3 else "v", int(i % 10 >= 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c string, y int").cache()
    for name, model in D.fit_baselines(df, "y", ["a", "b"], ["c"]).items():
        found = D.feature_importance(model, df)
        assert found[0][0] == "a" and sum(x for _, x in found) == pytest.approx(1) and len(found) >= 4, name
        report = {r["class"]: r for r in D.model_report(model, df, "y").collect()}
        assert set(report) == {0, 1} and report[1].support == 100 and report[1].auc > 0.99
        scored = D.with_score(model.transform(df))
        points = [(r.y, r.score) for r in scored.select("y", "score").collect()]
        for r in D.threshold_curve(scored, "score", "y", 20).collect():
            hits = [y for y, x in points if x >= r.threshold - 1e-12]
            assert abs(r.predicted - len(hits)) <= sum(abs(x - r.threshold) < 1e-9 for _, x in points)
            assert r.precision is None if not r.predicted else r.precision == r.hits / r.predicted
            assert r.recall == r.hits / 100


def test_profile_of_all_types(spark):
    rows = [(True, datetime.datetime(2024, 1, i + 1), decimal.Decimal("1.50") + i, datetime.date(2024, 2, 1), "a", 2**60 + i, [i], {"k": i})
            for i in range(9)] + [(None,) * 8]
    schema = "b boolean, t timestamp, d decimal(10,2), day date, s string, n bigint, l array<int>, `m.x` map<string,int>"
    got = {r.column: r for r in R.profile_table(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"b", "t", "d", "day", "s", "n", "l", "m.x"} and all((r.n_rows, r.n_columns) == (10, 8) for r in got.values())
    assert all(r.non_null == 9 for r in got.values())
    assert (got["b"].distinct, got["b"].least, got["t"].distinct, got["day"].greatest) == (1, "true", 9, "2024-02-01")
    assert got["t"].least.startswith("2024-01-01") and got["d"].greatest == "9.50"
    assert (got["n"].least, got["n"].greatest) == (str(2**60), str(2**60 + 8))  # not by way of a double
    assert (got["l"].distinct, got["l"].least) == (9, None)
    assert (got["s"].distinct, got["s"].top, got["s"].top_count) == (1, "a", 9)


@pytest.mark.parametrize("exact", [True, False])
def test_profile_of_an_empty_table(spark, exact):
    got = R.profile_table(spark.createDataFrame([], "b boolean, s string, n int"), exact).collect()
    assert sorted((r.column, r.non_null, r.n_rows) for r in got) == [("b", 0, 0), ("n", 0, 0), ("s", 0, 0)]
