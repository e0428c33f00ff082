"""Ranks and quantiles against numpy, on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mileglass.operators import preparation as P
from mileglass.operators import profiling as R
from mileglass.operators import ranking as K

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, and most rows one group."""
    rng = np.random.default_rng(7)
    n = 30_000
    v = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.lognormal(2, 2, n), 3))
    g = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": rng.permutation(n) % 997 + v})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(6).cache()
    return df, pdf


@pytest.mark.parametrize("accuracy", [10_000, 500])
def test_quantiles(skewed, accuracy):
    df, pdf = skewed
    got = {r.probability: r["quantile"] for r in
           K.exact_quantiles(df, ["v"], PROBS, accuracy=accuracy).collect()}
    want = np.quantile(pdf.v.dropna(), PROBS)
    assert np.allclose([got[p] for p in PROBS], want, rtol=1e-12)


def test_a_missed_bracket_is_widened(skewed):
    df, pdf = skewed
    narrow = K._bracketed_quantiles(df, ["v"], PROBS, (), False, 20, 0.001).collect()
    assert any(r["quantile"] is None for r in narrow)
    got = {r.probability: r["quantile"] for r in K.exact_quantiles(df, ["v"], PROBS, accuracy=20, reach=0.001).collect()}
    assert np.allclose([got[p] for p in PROBS], np.quantile(pdf.v.dropna(), PROBS), rtol=1e-12)


def test_quantiles_by_group(skewed):
    df, pdf = skewed
    got = {(r.g, r.probability): r["quantile"] for r in
           K.exact_quantiles(df, ["v"], [0.25, 0.5], by=["g"], accuracy=300).collect()}
    want = pdf.groupby("g").v.quantile([0.25, 0.5])
    assert len(got) == 8
    for (g, p), v in want.items():
        assert got[(g, p)] == pytest.approx(v)


def test_discrete_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    got = K.exact_quantiles(df, ["v"], [0.0, 0.1, 0.11, 0.8, 1.0], discrete=True).orderBy("probability")
    assert [r["quantile"] for r in got.collect()] == [1, 1, 2, 8, 10]


def test_average_ranks_and_spearman(skewed):
    df, pdf = skewed
    ranks = K.average_ranks(df, ["v"]).toPandas()
    want = pdf.v.dropna().rank()
    merged = pd.DataFrame({"value": pdf.v.dropna(), "want": want}).drop_duplicates().merge(ranks, on="value")
    assert len(merged) == len(ranks) and (merged.want == merged["rank"]).all()
    both = pdf.dropna(subset=["v"])
    rho = np.corrcoef(both.v.rank(), both.w.rank())[0, 1]
    assert K.spearman(df, "v", "w").first().rho == pytest.approx(rho, abs=1e-9)


def test_auc(skewed):
    df, pdf = skewed
    labelled = df.withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    both = pdf.dropna(subset=["v"])
    y, r = (both.id % 3 == 0), both.v.rank()
    p, n = y.sum(), len(y)
    want = (r[y].sum() - p * (p + 1) / 2) / (p * (n - p))
    assert K.area_under_curve(labelled, "v", "y").first().auc == pytest.approx(want, abs=1e-12)


def test_lookup_meets_null_keys(spark):
    big = spark.range(100).select(F.nullif(F.col("id") % 10, F.lit(3)).alias("k"))
    small = spark.range(10).select(F.nullif(F.col("id"), F.lit(3)).alias("k"), (F.col("id") * 2).alias("v"))
    got = K.attach(big, small, ["k"])
    assert got.columns == ["k", "v"] and got.agg(F.sum("v")).first()[0] == 900


def test_rows_without_a_target_are_a_stratum(spark):
    df = spark.range(600).select("id", F.nullif(F.col("id") % 3, F.lit(0)).alias("y"))
    split = P.stratified_split(df, "y", "id", 0.75)
    assert split.filter("is_train").count() + split.filter("not is_train").count() == 600
    assert {r.y: r.n for r in split.filter("is_train").groupBy("y").agg(F.count("*").alias("n")).collect()} == {
        None: 150, 1: 150, 2: 150}
    assert P.class_weights(df, "y").filter("class_weight is null or class_weight != 1").count() == 0
    assert P.impute_group_median(df.withColumn("v", F.when(F.col("id") > 9, 4.0)), "v", "y").filter("v is null").count() == 0


def test_ranges_do_not_change_the_sums(spark):
    counts = spark.range(5000).select((F.col("id") % 3).alias("column"), F.nullif(F.col("id"), F.lit(7)).cast("double").alias("value"),
                                      F.lit(2).cast("bigint").alias("n"))
    got = K.with_running_counts(counts, ["column"])
    assert got.count() == 5000 and got.filter("value is null and before = 0").count() == 1
    assert got.groupBy("column").agg((F.max("before") / 2 + 1 - F.count("*")).alias("d")).filter("d != 0").count() == 0


def test_group_medians_fill_only_their_group(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 10.0), ("b", None), (None, None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted((str(r.g), r.v) for r in P.impute_group_median(df, "v", "g").collect() if r.v is not None)
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("b", 10.0)]


def test_split_keeps_the_ratio(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") % 25 < 4, 1).otherwise(0).alias("y"))
    got = {r.y: r.share for r in P.stratified_split(df, "y", "id").groupBy("y").agg(
        F.avg(F.col("is_train").cast("double")).alias("share")).collect()}
    assert got == {0: 0.8, 1: 0.8}


def test_profile_without_exact_top(spark, sf_dir):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "n int, s string")
    exact = {r["column"]: r for r in R.profile_table(df).collect()}
    rough = {r["column"]: r for r in R.profile_table(df, exact_top=False).collect()}
    assert (exact["n"].q50, exact["s"].top, exact["s"].top_count) == (2.0, "x", 2)
    assert rough["s"]["distinct"] == 1


def test_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    got = P.winsorize(df, "v").agg(F.min("v"), F.max("v"), F.count("*"), F.count("v")).first()
    assert tuple(got) == (1.0, 99.0, 102, 101)


def test_a_hot_group_is_not_shuffled_for_its_lookup(spark, monkeypatch):
    df = spark.range(60_000).select("id", (F.col("id") % 1000).cast("double").alias("v"), F.when(F.col("id") > 9, "all").alias("g"))
    plans, attach = [], K.attach

    def watched(big, small, on):
        joined = attach(big, small, on)
        # Running counts are joined by stretches, each a task's share of the rows.
        if "_stretch" not in on:
            plans.append(joined._jdf.queryExecution().sparkPlan().toString())
        return joined

    for module in (K, P):
        monkeypatch.setattr(module, "attach", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        P.winsorize(df, "v"), P.robust_scale(df, ["v"]), P.class_weights(df, "g"), P.stratified_split(df, "g", "id")
        assert len(plans) == 5 and all("BroadcastHashJoin" in p for p in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
