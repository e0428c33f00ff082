"""Aggregated reports over trip tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mileglass import schema as S


def _count():
    return F.count(F.lit(1))


def fare_filter(df: DataFrame, condition: str = "fare_amount < 30") -> DataFrame:
    return df.filter(F.expr(condition))


def quality_metrics(df: DataFrame) -> DataFrame:
    """Row count, exact distinct zips, averages and pickup range of a table.

    Two exact distinct counts in one aggregate would send every row through an
    Expand three times.  Grouping by the pair of zips first keeps one pass and
    leaves a small table for the distinct counts.
    """
    pairs = df.groupBy("pickup_zip", "dropoff_zip").agg(
        _count().alias("n"),
        F.sum("trip_distance").alias("sd"), F.count("trip_distance").alias("nd"),
        F.sum("fare_amount").alias("sf"), F.count("fare_amount").alias("nf"),
        F.min(S.PICKUP).alias("lo"), F.max(S.PICKUP).alias("hi"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.countDistinct("pickup_zip").alias("distinct_pickup_zips"),
        F.countDistinct("dropoff_zip").alias("distinct_dropoff_zips"),
        (F.sum("sd") / F.nullif(F.sum("nd"), F.lit(0))).alias("avg_trip_distance"),
        (F.sum("sf") / F.nullif(F.sum("nf"), F.lit(0))).alias("avg_fare_amount"),
        F.min("lo").alias("earliest_pickup"), F.max("hi").alias("latest_pickup"),
    ).withColumn("quality_check_timestamp", F.current_timestamp())


def hourly_summary(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.date_trunc("hour", S.PICKUP).alias("pickup_hour"))
            .agg(_count().alias("trips_per_hour"),
                 F.avg("trip_distance").alias("avg_distance"),
                 F.avg("fare_amount").alias("avg_fare"),
                 F.countDistinct("pickup_zip").alias("unique_pickup_zones"))
            .orderBy("pickup_hour"))


def hour_of_day_trips(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.hour(S.PICKUP).alias("pickup_hour"))
            .agg(_count().alias("trip_count"), F.avg("fare_amount").alias("avg_fare"))
            .orderBy("pickup_hour"))


def top_zips(df: DataFrame, n: int = 10) -> DataFrame:
    """The n busiest pickup zips; ties go to the smaller zip."""
    return (df.groupBy("pickup_zip")
            .agg(_count().alias("trip_count"), F.avg("trip_distance").alias("avg_distance"))
            .orderBy(F.desc("trip_count"), "pickup_zip").limit(n))


def source_coverage(df: DataFrame, year: int = S.SOURCE_YEAR,
                    months: Iterable[int] = S.SOURCE_MONTHS) -> DataFrame:
    """Rows per day of month and hour in the given months of a year.

    The year is also given as a range, which the file reader can use.
    """
    ts = F.col(S.PICKUP)
    in_year = ((ts >= F.lit(f"{year}-01-01 00:00:00").cast("timestamp"))
               & (ts < F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp")))
    return (df.filter(in_year & F.month(ts).isin(*months))
            .groupBy(F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"))
            .agg(_count().alias("records")).orderBy("day", "hour"))


def quality_trend(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows and average fare of the newest n export hours."""
    return (df.groupBy("export_hour")
            .agg(_count().alias("records"), F.avg("fare_amount").alias("avg_fare"))
            .orderBy(F.desc("export_hour")).limit(n))


def row_count_check(df: DataFrame, more_than: int = 5) -> DataFrame:
    return df.agg(_count().alias("row_count")).withColumn(
        "passed", F.col("row_count") > more_than)


def last_user_message(df: DataFrame, role: str = "user") -> DataFrame:
    """The latest message of a role per conversation.

    ``max`` over turns combines on the map side, so a conversation holding a
    large share of all rows still reaches the shuffle as one row per task.
    """
    human = df.filter((F.col("role") == role) & F.col("turn").isNotNull())
    return (human.groupBy("conv_id").agg(F.max("turn").alias("turn"))
            .withColumn("anchor_message_id",
                        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))))
