"""Landing, bronze, silver and gold tables.

Each transform serves batch and streaming input alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mileglass import schema as S
from mileglass.functions import trips as M
from mileglass.operators.stamps import cast_schema, stamp_bronze


def with_duration(df: DataFrame) -> DataFrame:
    """Add ``trip_duration_minutes`` and ``is_valid_trip``."""
    minutes = M.duration_minutes(F.col(S.PICKUP), F.col(S.DROPOFF))
    return (df.withColumn("trip_duration_minutes", minutes)
            .withColumn("is_valid_trip", M.is_valid_duration(F.col("trip_duration_minutes"))))


def bronze(df: DataFrame) -> DataFrame:
    """Typed trip columns, batch stamps, file lineage, duration and validity."""
    extra = [c for c in df.columns if c not in S.TRIP_COLUMNS]
    return with_duration(cast_schema(df, S.TRIP, extra))


def bronze_from_landing(df: DataFrame) -> DataFrame:
    """The batch pipeline's bronze: typed columns, landing and bronze stamps."""
    return stamp_bronze(cast_schema(df, S.TRIP, ["ingestion_timestamp", "source_system"]))


def valid_trips(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_valid_trip"))


def with_pickup_calendar(df: DataFrame) -> DataFrame:
    """Add pickup hour, day of week (Sunday is 1) and the weekend flag."""
    return (df.withColumn("pickup_hour", F.hour(S.PICKUP))
            .withColumn("pickup_day_of_week", F.dayofweek(S.PICKUP))
            .withColumn("is_weekend", M.is_weekend(F.col("pickup_day_of_week"))))


def silver(df: DataFrame) -> DataFrame:
    """Valid trips with distance class, fare per mile and calendar columns."""
    enriched = valid_trips(df).withColumns({
        "distance_category": M.distance_category(F.col("trip_distance")),
        "fare_per_mile": M.fare_per_mile(F.col("fare_amount"), F.col("trip_distance")),
    })
    return with_pickup_calendar(enriched).withColumn(
        "time_period", M.time_period(F.col("pickup_hour")))


def gold_hourly(df: DataFrame, watermark: str = S.WATERMARK) -> DataFrame:
    """Hourly measures per export hour, time period and weekend flag.

    On a stream the hour is a tumbling window under a watermark, because a
    truncated timestamp would lose the watermark; its start is the same hour.
    All measures have partial aggregates, so hot keys shrink before the
    shuffle.
    """
    if df.isStreaming:
        df = df.withWatermark(S.PICKUP, watermark)
        hour = F.window(S.PICKUP, "1 hour").alias("_hour")
        start = F.col("_hour.start")
    else:
        hour = F.date_trunc("hour", S.PICKUP).alias("_hour")
        start = F.col("_hour")

    def of_category(name):
        return F.count(F.when(F.col("distance_category") == name, 1))

    grouped = df.groupBy(hour, "export_hour", "time_period", "is_weekend").agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.approx_count_distinct("batch_id").alias("unique_batches"),
        F.avg("trip_distance").alias("avg_distance"),
        F.avg("fare_amount").alias("avg_fare"),
        F.avg("trip_duration_minutes").alias("avg_duration_minutes"),
        F.avg("fare_per_mile").alias("avg_fare_per_mile"),
        F.min(S.PICKUP).alias("window_start"),
        F.max(S.PICKUP).alias("window_end"),
        of_category("short").alias("short_trips"),
        of_category("medium").alias("medium_trips"),
        of_category("long").alias("long_trips"),
        F.count(F.when(F.col("is_valid_trip"), 1)).alias("valid_trips"),
    )
    return grouped.select("export_hour", start.alias("pickup_hour_window"),
                          *[c for c in grouped.columns if c not in ("_hour", "export_hour")])
