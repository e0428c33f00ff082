"""Registered streaming queries: each runs to the end of its input and
returns the stored result, so it can be compared like a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from mileglass import schema as S
from mileglass.operators import layers as L
from mileglass.operators.expectations import batch_trip_rules, guard_stream
from mileglass.operators.stamps import cast_schema, stamp_landing
from mileglass.plans.trip_queries import (BATCH_RULES_SQL, GOLD_AVERAGES, GOLD_SELECT, SILVER_CTE,
                                          TABLE_RULES, TRIPS_CTE, rounded)
from mileglass.session import run_dir
from mileglass.sources.adapters import trips, trips_from_events
from mileglass.sources.batches import Layer, write_layer
from mileglass.sources.tables import driver_table, stream_files, with_lineage
from mileglass.streaming.layers import TripLayers, read_layer_stream, run_layer

SILVER_COLS = ("trip_id, batch_id, export_hour, trip_duration_minutes, distance_category, "
               "fare_per_mile, pickup_hour, pickup_day_of_week, is_weekend, time_period")


def event_stream(spark, sf_dir, max_files=S.MAX_FILES_PER_TRIGGER):
    """The event table as a file stream; the pattern also matches one file."""
    schema = driver_table(spark, sf_dir, "events").schema
    return stream_files(spark, f"{sf_dir}/events.parque*", schema, max_files)


def trip_stream(spark, sf_dir):
    return trips_from_events(with_lineage(event_stream(spark, sf_dir)), keep=tuple(S.LINEAGE))


def _stream_files(spark, sf_dir):
    return run_layer(event_stream(spark, sf_dir), Layer("events", run_dir(spark, "stream"), "bronze"))


def _twice(spark, sf_dir):
    layer = Layer("events", run_dir(spark, "stream"), "bronze")
    run_layer(event_stream(spark, sf_dir), layer)
    again = run_layer(event_stream(spark, sf_dir), layer)
    return again.groupBy("event_type").agg(F.count(F.lit(1)).alias("records"),
                                           F.countDistinct("event_id").alias("distinct_records"))


def _to_silver(spark, sf_dir):
    layers = TripLayers(spark, run_dir(spark, "stream"), TABLE_RULES)
    return layers.run_to_silver(trip_stream(spark, sf_dir)).select(*SILVER_COLS.split(", "))


def _gold(spark, sf_dir):
    layers = TripLayers(spark, run_dir(spark, "stream"), TABLE_RULES)
    return rounded(layers.run_all(trip_stream(spark, sf_dir)), *GOLD_AVERAGES)


def _approx_distinct(spark, sf_dir):
    stream = trips_from_events(event_stream(spark, sf_dir, None)).withWatermark(S.PICKUP, S.WATERMARK)
    counted = stream.groupBy(F.window(S.PICKUP, "1 hour").alias("w")).agg(
        F.approx_count_distinct("batch_id").alias("unique_batches"))
    layer = Layer("batches", run_dir(spark, "stream"), "gold")
    return run_layer(counted.select(F.col("w.start").alias("pickup_hour_window"), "unique_batches"), layer)


def _late(spark, sf_dir):
    """January arrives after February has moved the watermark past it."""
    layers = TripLayers(spark, run_dir(spark, "stream"))
    history = L.silver(L.bronze(trips(spark, sf_dir)))
    early = F.col(S.PICKUP) < F.lit("2024-02-01 00:00:00").cast("timestamp")
    for part in (history.filter(~early), history.filter(early)):
        part.write.mode("append").parquet(layers.silver.path)
        stored = layers.run_gold(history.schema)
    return rounded(stored, *GOLD_AVERAGES)


def _reload(spark, sf_dir):
    root = run_dir(spark, "stream")
    landing = Layer("landing", root, "bronze")
    rows = stamp_landing(cast_schema(trips(spark, sf_dir), keep=["trip_id"]))
    schema = write_layer(rows, landing).schema
    typed = L.bronze_from_landing(read_layer_stream(spark, landing, schema))
    stored = run_layer(guard_stream(typed, batch_trip_rules(), "bronze_rules"),
                       Layer("bronze", root, "bronze"))
    return stored.select(*S.TRIP_COLUMNS, "source_system", "data_quality_status")


QUERIES = {
    "stream_files": _stream_files,
    "stream_landing_to_silver": _to_silver,
    "gold_stream": _gold,
    "late_drop": _late,
    "approx_distinct_stream": _approx_distinct,
    "exactly_once_files": _twice,
    "batch_stream_reload": _reload,
}

# A window is written once the watermark, ten minutes behind the latest
# pickup, has passed its end.
_CLOSED = """date_trunc('hour', tpep_pickup_datetime) + INTERVAL 1 HOUR
    <= (SELECT max(tpep_pickup_datetime) FROM {table}) - INTERVAL 10 MINUTE"""

# The streams also drop fares that are not above zero.
_STREAM_SILVER = SILVER_CTE.replace("AND fare_amount < 1000", "AND fare_amount < 1000 AND fare_amount > 0")

ORACLES = {
    "stream_files": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "stream_landing_to_silver": f"WITH {_STREAM_SILVER} SELECT {SILVER_COLS} FROM silver",
    "gold_stream": f"WITH {_STREAM_SILVER}" + GOLD_SELECT.format(where="WHERE " + _CLOSED.format(table="silver")),
    "late_drop": f"WITH {SILVER_CTE}" + GOLD_SELECT.format(
        where="WHERE tpep_pickup_datetime >= TIMESTAMP '2024-02-01' AND " + _CLOSED.format(table="silver")),
    "approx_distinct_stream": f"""WITH {TRIPS_CTE} SELECT date_trunc('hour', tpep_pickup_datetime) AS pickup_hour_window,
        count(DISTINCT batch_id) AS unique_batches FROM trips WHERE {_CLOSED.format(table='trips')} GROUP BY 1""",
    "exactly_once_files": """SELECT event_type, count(*) AS records, count(DISTINCT event_id) AS distinct_records
        FROM events GROUP BY event_type""",
    "batch_stream_reload": f"""WITH {TRIPS_CTE} SELECT tpep_pickup_datetime, tpep_dropoff_datetime, trip_distance,
        fare_amount, pickup_zip, dropoff_zip, 'nyc_taxi_simulation' AS source_system,
        'validated' AS data_quality_status FROM trips WHERE {" AND ".join(f"({c})" for _, _, c in BATCH_RULES_SQL)}""",
}
