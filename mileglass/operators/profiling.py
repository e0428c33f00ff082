"""Column profiles and relations between columns, one aggregate pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mileglass.operators.ranking import attach, exact_quantiles, numeric_columns, pivot_quantiles

QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _per_column(df: DataFrame, columns: Sequence[str], measures) -> DataFrame:
    """One aggregate over all columns, turned into one row per column.

    ``measures`` maps a column to {name: aggregate}.
    """
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        made = measures(c)
        aggregates += [m.alias(f"_{i}_{name}") for name, m in made.items()]
        rows.append(F.struct(F.lit(c).alias("column"), *(F.col(f"_{i}_{name}").alias(name) for name in made)))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _has_hash(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_hash(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_has_hash(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType)


def profile_table(df: DataFrame, exact_top: bool = True) -> DataFrame:
    """One row per column, with the shape of the table (``n_rows``, ``n_columns``) on each.

    All: values that are not NULL, the least and the greatest as text, compared in the column's own type (NULL for
    types without an order).  Numeric: mean, stddev, min, exact quartiles, max.  Text: distinct values, the most
    frequent one (ties go to the smaller) and its frequency.  Booleans, times and other types: distinct values by a
    mergeable sketch of fixed size (NULL for maps and variants).  ``exact_top=False`` takes the sketch for text as well and leaves out the most
    frequent value, which needs no shuffle of the values.
    """
    numbers, texts = numeric_columns(df), string_columns(df)
    others = [c for c in df.columns if c not in numbers and c not in texts]
    types = column_types(df)

    def ends(c):
        ordered = isinstance(df.schema[c].dataType, T.AtomicType) and not isinstance(df.schema[c].dataType, T.VariantType)
        return {name: of(F.col(f"`{c}`")).cast("string") if ordered else F.lit(None).cast("string")
                for name, of in (("least", F.min), ("greatest", F.max))}

    def counted(c):
        return {"data_type": F.lit(types[c]), "non_null": F.count(f"`{c}`")}

    def sketched(c):
        # Maps and variants have no hash; a NULL is no value.
        value = F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))) if _has_hash(df.schema[c].dataType) else None
        distinct = F.lit(None).cast("bigint") if value is None else F.hll_sketch_estimate(F.hll_sketch_agg(value))
        return counted(c) | {"distinct": distinct} | ends(c)

    def numeric(c):
        v = F.col(f"`{c}`").cast("double")
        return counted(c) | {"mean": F.avg(v), "stddev": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)} | ends(c)

    parts = []
    if numbers:
        quartiles = pivot_quantiles(exact_quantiles(df, numbers, list(QUARTILES)), [], QUARTILES)
        parts.append(attach(_per_column(df, numbers, numeric), quartiles, ["column"]))
    if texts and exact_top:
        pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in texts))
        counts = (df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
                  .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        tops = counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("distinct"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
            F.max("n").alias("top_count"))
        parts.append(attach(_per_column(df, texts, lambda c: counted(c) | ends(c)), tops, ["column"])
                     .withColumn("distinct", F.coalesce("distinct", F.lit(0))))
    elif texts:
        parts.append(_per_column(df, texts, sketched))
    if others:
        parts.append(_per_column(df, others, sketched))
    if not parts:
        raise ValueError("a table without columns has no profile")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({"n_rows": df.agg(F.count(F.lit(1))).scalar(), "n_columns": F.lit(len(df.columns))})


def wrong_type_columns(df: DataFrame) -> DataFrame:
    """Text columns and how many of their values are numbers."""
    counted = _per_column(df, string_columns(df), lambda c: {
        "non_null": F.count(c), "numeric": F.count(F.col(c).try_cast("double"))})
    return counted.withColumn("all_numeric", (F.col("non_null") > 0) & (F.col("non_null") == F.col("numeric")))


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column, most first."""
    counted = _per_column(df, df.columns, lambda c: {"nulls": F.count_if(F.col(c).isNull())})
    return counted.orderBy(F.desc("nulls"), "column")


def null_rate_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(F.col(column).isNull().cast("double")).alias("null_rate"),
                                 F.count(F.lit(1)).alias("group_rows"))


def missingness_class(df: DataFrame, group: str, column: str, spread: float = 0.1) -> DataFrame:
    """MCAR if all groups miss about the same share, MAR if one misses more.

    That a value is missing because of itself cannot be read from the data.
    """
    rates = null_rate_by_group(df, group, column)
    return rates.agg(F.min("null_rate").alias("lowest"), F.max("null_rate").alias("highest")).select(
        F.lit(column).alias("column"), "lowest", "highest",
        F.when(F.col("highest") == 0, "complete")
        .when(F.col("highest") - F.col("lowest") > spread, "MAR").otherwise("MCAR").alias("missingness"))


def skewness(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 1.0) -> DataFrame:
    """Bias-corrected skew per numeric column, ascending, flagged beyond the limit."""
    counted = _per_column(df, columns or numeric_columns(df), lambda c: {
        "n": F.count(c), "population": F.skewness(F.col(c).cast("double"))})
    n = F.col("n").cast("double")
    corrected = F.when(n > 2, F.col("population") * F.sqrt(n * (n - 1)) / (n - 2))
    return (counted.select("column", corrected.alias("skew"))
            .withColumn("skewed", F.abs("skew") > limit).orderBy("skew"))


def target_balance(df: DataFrame, target: str, imbalanced_at: float = 0.84) -> DataFrame:
    """Share per target value; imbalanced if one value reaches the limit."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    share = F.col("n") / whole.select("total").scalar()
    largest = whole.select((F.col("largest") / F.col("total")).alias("s")).scalar()
    return counts.withColumn("share", share).withColumn("imbalanced", largest >= imbalanced_at)


def correlations_with(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Pearson r of each feature with the target, strongest first."""
    t = F.col(target).cast("double")
    found = _per_column(df, features, lambda c: {"r": F.corr(F.col(c).cast("double"), t)})
    return found.orderBy(F.desc(F.abs("r")), "column")


def correlation_pairs(df: DataFrame, features: Sequence[str], above: float | None = 0.7) -> DataFrame:
    """Feature pairs by Pearson r; ``above=None`` gives the whole upper matrix."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    sums = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}")
                    for i, (a, b) in enumerate(pairs)))
    rows = sums.select(F.inline(F.array(*(
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"_{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)))))
    return rows if above is None else rows.filter(F.abs("r") > above)


def group_target_mean(df: DataFrame, group: str, target: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(F.col(target).cast("double")).alias("target_mean"),
                                 F.count(F.lit(1)).alias("group_rows"))
