"""Baseline classifiers and their evaluation on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mileglass.functions.hashing import md5_number
from mileglass.operators.ranking import area_under_curve, attach, exact_quantiles, pivot_quantiles


def estimators(target: str, weight: str | None, seed: int = 42) -> dict:
    """In the order they are tried."""
    common = {"labelCol": target, **({"weightCol": weight} if weight else {})}
    return {
        "logistic_regression": LogisticRegression(maxIter=20, **common),
        "random_forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common),
        "gradient_boosted_trees": GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common),
    }


def encoding(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """The stages that make the feature vector."""
    indexed = [f"{c}_index" for c in categorical]
    coded = [f"{c}_code" for c in categorical]
    stages = []
    if categorical:
        stages = [StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
                  OneHotEncoder(inputCols=indexed, outputCols=coded)]
    return [*stages, VectorAssembler(inputCols=[*numeric, *coded], outputCol="features")]


def pipeline(estimator, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Pipeline:
    """Encoding and model in one pipeline, so nothing is learned from test rows."""
    return Pipeline(stages=[*encoding(numeric, categorical), estimator])


def fit_baselines(train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                  weight: str | None = None, only: Sequence[str] | None = None) -> dict:
    chosen = {k: e for k, e in estimators(target, weight).items() if only is None or k in only}
    return {name: pipeline(e, numeric, categorical).fit(train) for name, e in chosen.items()}


def with_score(predictions: DataFrame) -> DataFrame:
    """Add ``score``, the probability of class 1."""
    from pyspark.ml.functions import vector_to_array
    return predictions.withColumn("score", vector_to_array("probability")[1])


def with_folds(df: DataFrame, target: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``, from 0: equal shares of every target value, fixed by the key.

    The fold tells in which of ``folds`` equal stretches the hash of the key ranks among its target value; the borders
    are exact quantiles, so no class is sorted in one task.  Rows without a key are in fold 0.
    """
    hashed = df.withColumn("_hash", md5_number(F.col(key), seed, 12))
    shares = {k / folds: f"_cut_{k}" for k in range(1, folds)}
    cuts = pivot_quantiles(exact_quantiles(hashed, ["_hash"], list(shares), by=[target], discrete=True), [target], shares).drop("column")
    above = sum((F.coalesce(F.col("_hash") > F.col(c), F.lit(False)).cast("int") for c in shares.values()), F.lit(0))
    return attach(hashed, cuts, [target]).withColumn("fold", above).drop("_hash", *shares.values())


def cross_validate(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                   weight: str | None = None, fold: str = "fold", folds: int = 5, seed: int = 42) -> dict[str, float]:
    """Mean AUC per model over the folds given by a column (see ``with_folds``).

    The scores are those of ``CrossValidator`` with ``foldCol``.  That encodes the rows of a fold again for each model
    and fits each model once more on all rows, for a model nobody asked for.  Here the encoding of a fold is fitted on
    its training rows once, and the models share the encoded rows.  Folds run side by side, two at a time.
    """
    kept = [target, *([weight] if weight else []), "features"]
    evaluator = BinaryClassificationEvaluator(labelCol=target)

    def of_fold(k: int) -> list[float]:
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        encoder = Pipeline(stages=encoding(numeric, categorical)).fit(train)
        train, test = (encoder.transform(part).select(*kept).cache() for part in (train, test))
        try:
            for part, rows in (("training", train), ("validation", test)):
                if rows.isEmpty():
                    raise ValueError(f"The {part} data at fold {k} is empty.")
            return [evaluator.evaluate(e.fit(train).transform(test)) for e in estimators(target, weight, seed).values()]
        finally:
            train.unpersist(), test.unpersist()

    with ThreadPoolExecutor(max_workers=2) as pool:
        scores = list(pool.map(inheritable_thread_target(df.sparkSession)(of_fold), range(folds)))
    return {name: float(sum(found) / folds) for name, found in zip(estimators(target, weight, seed), zip(*scores))}


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall and F1 per class from the confusion counts."""
    confusion = df.groupBy(F.col(label).alias("l"), F.col(prediction).cast(df.schema[label].dataType).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(zero).alias("hits")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")))
    sums = confusion.select(F.inline(sides)).groupBy("class").agg(
        *(F.sum(c).alias(c) for c in ("support", "predicted", "hits")))
    hits = F.col("hits").cast("double")

    def share(of):
        return F.coalesce(hits / F.nullif(of, F.lit(0)), F.lit(0.0))
    return sums.select(
        "class", "support", share(F.col("predicted")).alias("precision"), share(F.col("support")).alias("recall"),
        share((F.col("support") + F.col("predicted")) / 2).alias("f1"))


def threshold_curve(df: DataFrame, score: str, label: str, bins: int = 100) -> DataFrame:
    """Precision and recall of the rule "score at least t" for t = 0, 1/bins, ..., 1.

    Scores are counted by bin first; only the histogram, at most ``bins`` + 1 rows, is summed up from the top.
    """
    histogram = df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    every = df.sparkSession.range(bins + 1).select(F.col("id").alias("bin"))
    filled = every.join(histogram, "bin", "left").fillna(0)
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (filled.select((F.col("bin") / bins).alias("threshold"), F.sum("n").over(above).alias("predicted"),
                          F.sum("p").over(above).alias("hits"), F.sum("p").over(whole).alias("_all"))
            .select("threshold", "predicted", "hits", (F.col("hits") / F.nullif("predicted", F.lit(0))).alias("precision"),
                    (F.col("hits") / F.nullif("_all", F.lit(0))).alias("recall")))


def feature_importance(model: PipelineModel, example: DataFrame) -> list[tuple[str, float]]:
    """Features of a fitted pipeline with their share of the importance, the largest first.

    Trees give the gain of their splits; a linear model the size of its coefficients.
    """
    described = model.transform(example.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in described.values() for a in kind}
    fitted = model.stages[-1]
    sizes = [abs(float(x)) for x in (fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients).toArray()]
    total = sum(sizes) or 1.0
    return sorted(((names[i], x / total) for i, x in enumerate(sizes)), key=lambda f: (-f[1], f[0]))


def model_report(model: PipelineModel, test: DataFrame, target: str) -> DataFrame:
    """Per class of a model's own predictions: support, precision, recall, f1, and the AUC over all classes."""
    predicted = with_score(model.transform(test))
    return class_report(predicted, target, "prediction").crossJoin(F.broadcast(auc(predicted, "score", target)))  # one row


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return area_under_curve(df, score, label)
