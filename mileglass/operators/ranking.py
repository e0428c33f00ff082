"""Exact quantiles and ranks without sorting a group in one task.

Values are counted per distinct value first, so a value that fills a third of
the table is one row.  Counts are dealt out in ranges, stored once and ranked
range by range; the plan is the same for all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mileglass.session import run_dir

#: How much wider brackets get after one was missed.
WIDER = 8


def stored_lookup(small: DataFrame, label: str) -> DataFrame:
    """Write a lookup to the shared folder and read it back.

    The optimizer knows the bytes of a stored table before it plans, so a small one is broadcast at once.  Bytes known
    only after a shuffle come too late: few keys leave most shuffle partitions empty, and then AQE keeps the sort-merge
    join, in which a frequent key is one task.
    """
    path = run_dir(small.sparkSession, label)
    small.write.parquet(path)
    return small.sparkSession.read.schema(small.schema).parquet(path)


def attach(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a lookup; a NULL key meets a NULL key.

    How to join is left to the optimizer; ``stored_lookup`` tells it the bytes of the small side.
    """
    keys = {c: f"_key_{c}" for c in on}
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return big.join(small.withColumnsRenamed(keys), match, "left").drop(*keys.values())


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of (by..., column, value) with the NULL values left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in columns))
    return df.select(*by, F.inline(pairs)).filter(F.col("value").isNotNull())


def with_running_counts(counts: DataFrame, keys: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Add ``before``: the sum of ``n`` over smaller values of the same keys.

    ``counts`` holds one row per keys and value.  A NULL value sorts first.

    The rows are dealt out by ranges of keys and value, so that each task holds a stretch of the order, whatever the
    number of keys.  They are stored with their stretch; a sum per stretch tells what lies before it.
    """
    spark = counts.sparkSession
    path = run_dir(spark, "counts")
    (counts.repartitionByRange(*keys, F.asc_nulls_first(value))
     .withColumn("_stretch", F.spark_partition_id()).write.parquet(path))
    stored = spark.read.schema(T.StructType([*counts.schema.fields, T.StructField("_stretch", T.IntegerType())])).parquet(path)
    totals = stored.groupBy(*keys, "_stretch").agg(F.sum(n).alias("_total"))
    order = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(order), F.lit(0))).drop("_total")
    within = (Window.partitionBy(*keys, "_stretch").orderBy(F.asc_nulls_first(value))
              .rowsBetween(Window.unboundedPreceding, -1))
    return (attach(stored, offsets, [*keys, "_stretch"])
            .withColumn("before", F.col("_offset") + F.coalesce(F.sum(n).over(within), F.lit(0)))
            .drop("_stretch", "_offset"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    by: Sequence[str] = (), discrete: bool = False, accuracy: int = 10_000,
                    reach: float | None = None) -> DataFrame:
    """Exact quantiles: (by..., column, probability, n, quantile).

    Two passes.  A sketch with a stated rank error brackets each quantile; then rows below a bracket are only counted
    and rows inside it are ranked.  Should a quantile lie outside its bracket, both passes are repeated with wider
    brackets, up to the whole range.  Continuous quantiles interpolate between neighbours; discrete ones give the
    smallest value with at least that share at or below it.
    """
    reach = 5 / accuracy if reach is None else reach
    while True:
        found = _bracketed_quantiles(df, columns, probabilities, by, discrete, accuracy, min(reach, 1.0))
        stored = stored_lookup(found, "quantiles")
        if reach >= 1 or stored.filter(F.col("quantile").isNull()).isEmpty():
            return stored
        reach *= WIDER


def _bracketed_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str],
                         discrete: bool, accuracy: int, reach: float) -> DataFrame:
    """The same, with NULL for a quantile that is not within ``reach`` of where the sketch takes it to be."""
    keys = [*by, "column"]
    values = long_form(df, columns, by)
    lows = [max(p - reach, 0.0) for p in probabilities]
    highs = [min(p + reach, 1.0) for p in probabilities]
    sketch = values.groupBy(*keys).agg(
        F.count("value").alias("n"), F.min("value").alias("_min"), F.max("value").alias("_max"),
        F.percentile_approx("value", lows + highs, accuracy).alias("_q"))
    n = F.col("n")

    def bracket(i, p):
        rank = F.ceil(F.lit(p) * n) - 1 if discrete else F.lit(p) * (n - 1)
        # In a small group the reach is less than one row, so the bracket is the whole group.
        whole = n * reach < 5
        low = F.when(whole | F.lit(lows[i] == 0), F.col("_min")).otherwise(F.col("_q")[i])
        high = F.when(whole | F.lit(highs[i] == 1), F.col("_max")).otherwise(F.col("_q")[len(lows) + i])
        return F.struct(F.lit(float(p)).alias("probability"),
                        F.greatest(rank.cast("double"), F.lit(0.0)).alias("rank"),
                        low.alias("low"), high.alias("high"))
    brackets = stored_lookup(sketch.select(
        *keys, "n", F.array(*(bracket(i, p) for i, p in enumerate(probabilities))).alias("brackets")), "brackets")
    rows = (attach(values, brackets, keys)
            .select(*keys, F.col("n").alias("size"), "value", F.inline("brackets"))
            .filter(F.col("value") <= F.col("high")))
    groups = [*keys, "size", "probability", "rank"]
    counts = rows.groupBy(*groups, F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    ranked = with_running_counts(counts, groups)

    def at(rank):
        inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col("value")))
    floor, ceil = F.floor("rank"), F.ceil("rank")
    found = ranked.groupBy(*groups).agg(at(floor).alias("_a"), at(ceil).alias("_b"))
    quantile = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("rank") - floor)
    return found.select(*keys, "probability", F.col("size").alias("n"), quantile.alias("quantile"))


def pivot_quantiles(quantiles: DataFrame, by: Sequence[str], names: dict[float, str]) -> DataFrame:
    """One row per (by..., column) with one named column per probability."""
    return quantiles.groupBy(*by, "column").agg(*(
        F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for p, name in names.items()))


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, rank) per distinct value; ties share their mean rank."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_running_counts(counts, ["column"])
    return ranked.select("column", "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns over the rows that have both.

    Works on distinct pairs with their counts, stored once.  The ranks of both columns come from sums over the pairs;
    they are looked up by joins that the optimizer broadcasts or splits by size.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    path = run_dir(df.sparkSession, "pairs")
    both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")).write.parquet(path)
    pairs = df.sparkSession.read.schema("x double, y double, w bigint").parquet(path)

    def ranks(column):
        counts = pairs.groupBy(F.col(column).alias("value")).agg(F.sum("w").alias("n")).withColumn("column", F.lit(column))
        ranked = with_running_counts(counts, ["column"])
        return ranked.select(F.col("value").alias(column), "n", (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{column}"))

    rank_x, rank_y = ranks("x"), ranks("y")
    middle = (pairs.agg(F.sum("w")).first()[0] or 0) / 2 + 0.5
    crossed = attach(attach(pairs, rank_x.drop("n"), ["x"]), rank_y.drop("n"), ["y"]).agg(
        F.sum(F.col("w") * (F.col("rx") - middle) * (F.col("ry") - middle)).alias("ab"))
    alone = [r.agg(F.sum(F.col("n") * (F.col(c) - middle) * (F.col(c) - middle)).alias(name))
             for r, c, name in ((rank_x, "rx", "aa"), (rank_y, "ry", "bb"))]
    a, b = (t.scalar() for t in alone)
    return crossed.select(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"),
                          (F.col("ab") / F.sqrt(a * b)).alias("rho"))


def area_under_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact AUC from average ranks; labels are 0 and 1."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("ones"))
    ranked = with_running_counts(counts.withColumn("column", F.lit(score)), ["column"])
    rank = F.col("before") + (F.col("n") + 1) / 2
    p, n = F.sum("ones"), F.sum("n")
    area = (F.sum(F.col("ones") * rank) - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0))
    return ranked.agg(p.alias("positives"), (n - p).alias("negatives"), area.alias("auc"))


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]
