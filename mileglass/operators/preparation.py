"""Imputation, outlier handling, scaling, splits and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mileglass.functions.hashing import md5_number
from mileglass.operators.ranking import attach, exact_quantiles, pivot_quantiles, stored_lookup


def drop_rare_nulls(df: DataFrame, column: str, below: float = 0.05) -> DataFrame:
    """Drop the rows where the column is NULL if they are fewer than a share."""
    rate = df.agg(F.avg(F.col(column).isNull().cast("double")).alias("rate")).scalar()
    return df.filter(F.col(column).isNotNull() | ~(rate < below))


def impute(df: DataFrame, column: str, how: str = "median") -> DataFrame:
    """NULL becomes the exact median, or the mean, of the column."""
    if how == "mean":
        fill = df.agg(F.avg(column).alias("v")).scalar()
    elif how == "median":
        fill = exact_quantiles(df, [column], [0.5]).select("quantile").scalar()
    else:
        raise ValueError(f"unknown imputation {how!r}")
    return df.withColumn(column, F.coalesce(F.col(column), fill))


def impute_group_median(df: DataFrame, column: str, group: str) -> DataFrame:
    """NULL becomes the exact median of the row's group."""
    medians = exact_quantiles(df, [column], [0.5], by=[group]).select(group, F.col("quantile").alias("_median"))
    return attach(df, medians, [group]).withColumn(
        column, F.coalesce(F.col(column), F.col("_median"))).drop("_median")


def winsorize(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Cap a column at two exact percentiles; NULL stays NULL."""
    caps = pivot_quantiles(exact_quantiles(df, [column], [low, high]), [], {low: "low", high: "high"})
    capped = F.least(F.greatest(F.col(column), caps.select("low").scalar()), caps.select("high").scalar())
    return df.withColumn(column, F.when(F.col(column).isNotNull(), capped))


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range; a range of zero counts as one."""
    quantiles = exact_quantiles(df, list(columns), [0.25, 0.5, 0.75])
    # One row with all marks: three numbers for each column.
    marks = quantiles.agg(*(F.max(F.when((F.col("column") == c) & (F.col("probability") == p), F.col("quantile")))
                            .alias(f"{c} {p}") for c in columns for p in (0.25, 0.5, 0.75))).first()

    def scaled(c):
        low, middle, high = (marks[f"{c} {p}"] for p in (0.25, 0.5, 0.75))
        if middle is None:
            return F.lit(None).cast("double")
        return (F.col(c) - F.lit(middle)) / F.lit((high - low) or 1.0)
    return df.withColumns({c: scaled(c) for c in columns})


def stratified_split(df: DataFrame, target: str, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``: the same share of every target value, fixed by the key.

    A row is in training if the hash of its key is at most an exact quantile
    of its stratum, so no stratum is sorted in one task.  Rows without a target
    are a stratum of their own; rows without a key are not in training.
    """
    hashed = df.withColumn("_hash", md5_number(F.col(key), seed, 12))
    cuts = exact_quantiles(hashed, ["_hash"], [train], by=[target], discrete=True).select(
        target, F.col("quantile").alias("_cut"))
    return attach(hashed, cuts, [target]).withColumn(
        "is_train", F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False))).drop("_hash", "_cut")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Add ``class_weight``: n / (classes * rows of the class); NULL is a class."""
    counts = stored_lookup(df.groupBy(target).agg(F.count(F.lit(1)).alias("_rows")), "classes")
    whole = counts.agg((F.sum("_rows") / F.count(F.lit(1))).alias("v")).scalar()
    weights = counts.select(target, (whole / F.col("_rows")).alias("class_weight"))
    return attach(df, weights, [target])
