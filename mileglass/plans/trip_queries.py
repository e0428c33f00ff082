"""Registered queries over the trip view, each with its SQL counterpart.

Averages are rounded to eight digits on both sides, since the order of a
floating-point sum is not fixed.  (Fares have two decimals, so at six digits a
mean over 32 rows can lie exactly on a rounding edge.)  Columns that hold the wall clock are shown
as "is it set".
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from mileglass import schema as S
from mileglass.functions import trips as M
from mileglass.operators import expectations as Q
from mileglass.operators import layers as L
from mileglass.operators import metrics as R
from mileglass.operators import slicing as C
from mileglass.operators import stamps as P
from mileglass.plans import medallion
from mileglass.session import run_dir
from mileglass.sources import tables as T
from mileglass.sources.adapters import trips
from mileglass.sources.batches import Layer, write_layer

YEAR, MONTHS = 2024, (1, 2)
AS_OF = datetime(2025, 8, 15, 11, 30)
SLICE = dict(day=15, hour=10, year=YEAR, months=MONTHS)

# ---------------------------------------------------------------- SQL pieces
TRIPS_CTE = """
trips AS (
  SELECT trip_id, tpep_pickup_datetime,
         tpep_pickup_datetime + to_minutes(10 * k - 60) AS tpep_dropoff_datetime,
         k / 4.0::DOUBLE AS trip_distance, value AS fare_amount,
         CAST(CASE WHEN user_id = 0 THEN 0 ELSE 10000 + user_id END AS INTEGER) AS pickup_zip,
         CAST(10000 + (trip_id * 7) % 150 AS INTEGER) AS dropoff_zip,
         strftime(tpep_pickup_datetime, '%Y-%m-%dT%H') AS export_hour,
         'b' || CAST(trip_id % 3 AS VARCHAR) AS batch_id
  FROM (SELECT event_id AS trip_id, ts + to_days(CAST((event_id % 2) * 31 AS INTEGER)) AS tpep_pickup_datetime,
               user_id, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
        FROM events) AS e)"""

BRONZE_CTE = TRIPS_CTE + """,
bronze AS (
  SELECT *, (CAST(floor(epoch(tpep_dropoff_datetime)) AS BIGINT)
             - CAST(floor(epoch(tpep_pickup_datetime)) AS BIGINT)) / 60.0::DOUBLE AS trip_duration_minutes
  FROM trips),
flagged AS (
  SELECT *, coalesce(trip_duration_minutes > 0 AND trip_duration_minutes < 600, FALSE) AS is_valid_trip
  FROM bronze)"""

SILVER_CTE = BRONZE_CTE + """,
silver AS (
  SELECT *,
         CASE WHEN trip_distance <= 2 THEN 'short' WHEN trip_distance <= 10 THEN 'medium' ELSE 'long' END AS distance_category,
         CASE WHEN trip_distance > 0 THEN fare_amount / trip_distance ELSE 0 END AS fare_per_mile,
         CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
         CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS pickup_day_of_week,
         dayofweek(tpep_pickup_datetime) IN (0, 6) AS is_weekend,
         CASE WHEN hour(tpep_pickup_datetime) BETWEEN 6 AND 11 THEN 'morning'
              WHEN hour(tpep_pickup_datetime) BETWEEN 12 AND 17 THEN 'afternoon'
              WHEN hour(tpep_pickup_datetime) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS time_period
  FROM flagged WHERE is_valid_trip AND fare_amount < 1000)"""

GOLD_SELECT = """
SELECT export_hour, date_trunc('hour', tpep_pickup_datetime) AS pickup_hour_window, time_period, is_weekend,
       count(*) AS total_trips, count(DISTINCT batch_id) AS unique_batches,
       round(avg(trip_distance), 8) AS avg_distance, round(avg(fare_amount), 8) AS avg_fare,
       round(avg(trip_duration_minutes), 8) AS avg_duration_minutes,
       round(avg(fare_per_mile), 8) AS avg_fare_per_mile,
       min(tpep_pickup_datetime) AS window_start, max(tpep_pickup_datetime) AS window_end,
       count(*) FILTER (WHERE distance_category = 'short') AS short_trips,
       count(*) FILTER (WHERE distance_category = 'medium') AS medium_trips,
       count(*) FILTER (WHERE distance_category = 'long') AS long_trips,
       count(*) FILTER (WHERE is_valid_trip) AS valid_trips
FROM silver {where} GROUP BY 1, 2, 3, 4"""

TRIP_COLS = ("trip_id, tpep_pickup_datetime, tpep_dropoff_datetime, trip_distance, fare_amount, "
             "pickup_zip, dropoff_zip")
IN_SLICE = ("year(tpep_pickup_datetime) = 2024 AND month(tpep_pickup_datetime) IN (1, 2) "
            "AND day(tpep_pickup_datetime) = {day} AND hour(tpep_pickup_datetime) = {hour}")
IN_SAMPLE = "('0x' || substr(md5('42:' || CAST(trip_id AS VARCHAR)), 1, 8))::UBIGINT % 10000 < 7500"


def shifted(column: str, year: int, month: int) -> str:
    steps = " ".join(
        f"WHEN month({column}) = {m} THEN {column} + INTERVAL ({year - YEAR}) YEAR + INTERVAL ({month - m}) MONTH"
        for m in MONTHS)
    return f"CASE {steps} ELSE {column} END AS {column}"


def rules_sql(rules: list[tuple[str, str, str]], by: str = "") -> str:
    key, groups = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {key}'{name}' AS rule, '{action}' AS action, "
        f"count(*) FILTER (WHERE coalesce({cond}, FALSE)) AS passed, "
        f"count(*) FILTER (WHERE NOT coalesce({cond}, FALSE)) AS failed FROM trips{groups}"
        for name, action, cond in rules)


STREAM_RULES_SQL = [(r.name, r.action, r.condition) for r in Q.STREAM_TRIP_RULES]
BATCH_RULES_SQL = [
    ("valid_timestamps", "drop",
     "tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL "
     "AND tpep_dropoff_datetime > tpep_pickup_datetime"),
    ("valid_trip_distance", "drop", "trip_distance > 0"),
    ("valid_fare_amount", "drop", "fare_amount > 0"),
]


# ------------------------------------------------------------------- queries
def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 8) for c in columns})


GOLD_AVERAGES = ("avg_distance", "avg_fare", "avg_duration_minutes", "avg_fare_per_mile")


def _ids(df):
    return df.select(*TRIP_COLS.split(", "))


def _batch_layer(spark, sf_dir):
    layer = Layer("silver", run_dir(spark, "layer"), "silver")
    return write_layer(L.silver(L.bronze(trips(spark, sf_dir))), layer)


def _export(spark, sf_dir):
    batch = medallion.export_previous_hour(
        trips(spark, sf_dir), run_dir(spark, "landing"), AS_OF, source_year=YEAR,
        source_months=MONTHS, fraction=None, batch_id="batch-1")
    return spark.read.parquet(batch.path).withColumn("written_rows", F.lit(batch.rows)).drop("export_timestamp")


def _lineage(spark, sf_dir):
    df = T.with_lineage(T.driver_table(spark, sf_dir, "events"))
    name = F.regexp_extract("dlt_file_path", r"(events\.parquet)", 1)
    return df.groupBy(name.alias("table_file")).agg(
        F.count(F.lit(1)).alias("records"), F.count("dlt_load_timestamp").alias("stamped"))


def _landing_rows(spark, sf_dir):
    stamped = P.stamp_landing(P.cast_schema(trips(spark, sf_dir), keep=["trip_id"]))
    return stamped


# The given events hold fares of zero, which would rightly abort a run.  The
# registered flows therefore drop such rows; tests cover the failing case.
TABLE_RULES = tuple(Q.expect_drop(r.name, r.condition) if r.name == "valid_fare_amount" else r
                    for r in Q.STREAM_TRIP_RULES)


def _expect_fail(spark, sf_dir):
    return Q.publish(trips(spark, sf_dir), Q.STREAM_TRIP_RULES, run_dir(spark, "published"))


def _metrics_over_runs(spark, sf_dir):
    """All batches, then one of them again, as after a failed run."""
    path, rows = run_dir(spark, "metrics"), trips(spark, sf_dir)
    Q.record_metrics(rows, Q.STREAM_TRIP_RULES, path)
    return Q.record_metrics(rows.filter(F.col("batch_id") == "b1"), Q.STREAM_TRIP_RULES, path)


def _expect_warn(spark, sf_dir):
    rule = Q.expect_warn("valid_zip_codes", "pickup_zip > 0 AND dropoff_zip > 0")
    kept = Q.apply(trips(spark, sf_dir), [rule])
    return kept.select("trip_id", "pickup_zip", "dropoff_zip", rule.holds.alias("passed"))


def _expect_drop(spark, sf_dir):
    return _ids(Q.drop_violations(trips(spark, sf_dir), Q.batch_trip_rules()))


def _expect_set(spark, sf_dir):
    rules = [*TABLE_RULES, *Q.batch_trip_rules(),
             Q.expect_drop("cheap", "fare_amount < 100")]
    return _ids(Q.apply(trips(spark, sf_dir), rules))


def _both_rule_sets(spark, sf_dir):
    return Q.report(trips(spark, sf_dir), [*Q.STREAM_TRIP_RULES, *Q.batch_trip_rules()])


def _bronze(spark, sf_dir):
    return L.with_duration(trips(spark, sf_dir))


def _silver(spark, sf_dir):
    return medallion.drop_violations(_bronze(spark, sf_dir), Q.STREAM_TRIP_RULES).transform(L.silver)


def _clean(spark, sf_dir):
    return Q.drop_violations(trips(spark, sf_dir), Q.batch_trip_rules())


QUERIES = {
    "scan_table": lambda s, d: T.driver_table(s, d, "events"),
    "preview": lambda s, d: T.preview(trips(s, d).select("trip_id", *S.TRIP_COLUMNS), 10, "trip_id"),
    "file_lineage": _lineage,
    "export_batch": _export,
    "layer_sink": _batch_layer,
    "quality_trend_sql": lambda s, d: rounded(R.quality_trend(trips(s, d)), "avg_fare"),
    "fare_filter": lambda s, d: _ids(R.fare_filter(trips(s, d))),
    "calendar_slice": lambda s, d: _ids(C.calendar_slice(trips(s, d), **SLICE)),
    "previous_hour_slice": lambda s, d: _ids(C.previous_hour_slice(
        trips(s, d), AS_OF, source_year=YEAR, source_months=MONTHS, by_hash="trip_id")),
    "sample_rows": lambda s, d: _ids(C.sample_rows(trips(s, d), by_hash="trip_id")),
    "shift_to_month": lambda s, d: _ids(C.shift_to_month(
        trips(s, d), year=2025, month=9, source_year=YEAR, source_months=MONTHS)),
    "cast_schema": lambda s, d: P.cast_schema(
        trips(s, d).withColumn("trip_distance", F.col("trip_distance").cast("string")), keep=["trip_id"]),
    "require_columns": lambda s, d: P.require_columns(
        _landing_rows(s, d), also=["trip_id", "source_system", "data_quality_flag"]),
    "stamp_landing": lambda s, d: _landing_rows(s, d).select(
        "trip_id", "source_system", "data_quality_flag",
        F.col("ingestion_timestamp").isNotNull().alias("stamped")),
    "stamp_batch": lambda s, d: P.stamp_batch(trips(s, d), datetime(2025, 8, 15, 10), "batch-1").select(
        "trip_id", "batch_id", "source_system", "export_hour",
        F.col("export_timestamp").isNotNull().alias("stamped")),
    "stamp_bronze": lambda s, d: P.stamp_bronze(trips(s, d)).select(
        "trip_id", "data_quality_status", F.col("bronze_processing_timestamp").isNotNull().alias("stamped")),
    "trip_duration": lambda s, d: _bronze(s, d).select(
        "trip_id", F.round("trip_duration_minutes", 8).alias("trip_duration_minutes")),
    "valid_trip_flag": lambda s, d: _bronze(s, d).select("trip_id", "is_valid_trip"),
    "valid_trip_filter": lambda s, d: _ids(L.valid_trips(_bronze(s, d))),
    "distance_category": lambda s, d: trips(s, d).select(
        "trip_id", M.distance_category(F.col("trip_distance")).alias("distance_category")),
    "fare_per_mile": lambda s, d: trips(s, d).select("trip_id", F.round(
        M.fare_per_mile(F.col("fare_amount"), F.col("trip_distance")), 8).alias("fare_per_mile")),
    "pickup_calendar": lambda s, d: L.with_pickup_calendar(trips(s, d)).select(
        "trip_id", "pickup_hour", "pickup_day_of_week", "is_weekend"),
    "time_period": lambda s, d: trips(s, d).select(
        "trip_id", M.time_period(F.hour(S.PICKUP)).alias("time_period")),
    "hour_trunc": lambda s, d: trips(s, d).select(
        "trip_id", F.date_trunc("hour", S.PICKUP).alias("pickup_hour_window")),
    "timestamp_parts": lambda s, d: C.timestamp_parts(C.shift_to_month(
        trips(s, d), year=2025, month=9, source_year=YEAR, source_months=MONTHS)),
    "expect_warn": _expect_warn,
    "expect_drop": _expect_drop,
    "expect_fail": _expect_fail,
    "expect_set": _expect_set,
    "quality_rules_trip": _both_rule_sets,
    "expectation_report": _metrics_over_runs,
    "last_user_message": lambda s, d: R.last_user_message(T.driver_table(s, d, "conversations")),
    "quality_metrics": lambda s, d: rounded(
        R.quality_metrics(_clean(s, d)).drop("quality_check_timestamp"),
        "avg_trip_distance", "avg_fare_amount"),
    "hourly_summary": lambda s, d: rounded(R.hourly_summary(_clean(s, d)), "avg_distance", "avg_fare"),
    "gold_hourly": lambda s, d: rounded(medallion.gold_from_trips(trips(s, d)), *GOLD_AVERAGES),
    "hour_of_day_trips": lambda s, d: rounded(R.hour_of_day_trips(_clean(s, d)), "avg_fare"),
    "top_zips": lambda s, d: rounded(R.top_zips(_clean(s, d)), "avg_distance"),
    "source_coverage": lambda s, d: R.source_coverage(trips(s, d), YEAR, MONTHS),
    "row_count_check": lambda s, d: R.row_count_check(trips(s, d)),
}

_WITH_TRIPS = f"WITH {TRIPS_CTE} "
_WITH_FLAGGED = f"WITH {BRONZE_CTE} "
_CLEAN = " AND ".join(f"({c})" for _, _, c in BATCH_RULES_SQL)

ORACLES = {
    "scan_table": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "preview": f"{_WITH_TRIPS} SELECT {TRIP_COLS} FROM trips ORDER BY trip_id LIMIT 10",
    "file_lineage": "SELECT 'events.parquet' AS table_file, count(*) AS records, count(*) AS stamped FROM events",
    "export_batch": f"""{_WITH_TRIPS}, picked AS (SELECT * FROM trips WHERE {IN_SLICE.format(day=15, hour=10)})
        SELECT {shifted('tpep_pickup_datetime', 2025, 8)}, {shifted('tpep_dropoff_datetime', 2025, 8)},
               trip_distance, fare_amount, pickup_zip, dropoff_zip, 'batch-1' AS batch_id,
               'nyc_taxi_export' AS source_system, '2025-08-15T10' AS export_hour,
               (SELECT count(*) FROM picked) AS written_rows FROM picked""",
    "layer_sink": f"""WITH {BRONZE_CTE} SELECT
        tpep_pickup_datetime, tpep_dropoff_datetime, trip_distance, fare_amount, pickup_zip, dropoff_zip, trip_id,
        export_hour, batch_id, trip_duration_minutes, is_valid_trip,
        CASE WHEN trip_distance <= 2 THEN 'short' WHEN trip_distance <= 10 THEN 'medium' ELSE 'long' END AS distance_category,
        CASE WHEN trip_distance > 0 THEN fare_amount / trip_distance ELSE 0 END AS fare_per_mile,
        CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
        CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS pickup_day_of_week,
        dayofweek(tpep_pickup_datetime) IN (0, 6) AS is_weekend,
        CASE WHEN hour(tpep_pickup_datetime) BETWEEN 6 AND 11 THEN 'morning'
             WHEN hour(tpep_pickup_datetime) BETWEEN 12 AND 17 THEN 'afternoon'
             WHEN hour(tpep_pickup_datetime) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS time_period
        FROM flagged WHERE is_valid_trip""",
    "quality_trend_sql": f"""{_WITH_TRIPS} SELECT export_hour, count(*) AS records, round(avg(fare_amount), 8) AS avg_fare
        FROM trips GROUP BY export_hour ORDER BY export_hour DESC LIMIT 10""",
    "fare_filter": f"{_WITH_TRIPS} SELECT {TRIP_COLS} FROM trips WHERE fare_amount < 30",
    "calendar_slice": f"{_WITH_TRIPS} SELECT {TRIP_COLS} FROM trips WHERE {IN_SLICE.format(day=15, hour=10)}",
    "previous_hour_slice": f"""{_WITH_TRIPS} SELECT trip_id, {shifted('tpep_pickup_datetime', 2025, 8)},
        {shifted('tpep_dropoff_datetime', 2025, 8)}, trip_distance, fare_amount, pickup_zip, dropoff_zip
        FROM trips WHERE {IN_SLICE.format(day=15, hour=10)} AND {IN_SAMPLE}""",
    "sample_rows": f"{_WITH_TRIPS} SELECT {TRIP_COLS} FROM trips WHERE {IN_SAMPLE}",
    "shift_to_month": f"""{_WITH_TRIPS} SELECT trip_id, {shifted('tpep_pickup_datetime', 2025, 9)},
        {shifted('tpep_dropoff_datetime', 2025, 9)}, trip_distance, fare_amount, pickup_zip, dropoff_zip FROM trips""",
    "cast_schema": f"{_WITH_TRIPS} SELECT {TRIP_COLS} FROM trips",
    "require_columns": f"""{_WITH_TRIPS} SELECT {TRIP_COLS}, 'nyc_taxi_simulation' AS source_system,
        'pending_validation' AS data_quality_flag FROM trips""",
    "stamp_landing": """SELECT event_id AS trip_id, 'nyc_taxi_simulation' AS source_system,
        'pending_validation' AS data_quality_flag, TRUE AS stamped FROM events""",
    "stamp_batch": """SELECT event_id AS trip_id, 'batch-1' AS batch_id, 'nyc_taxi_export' AS source_system,
        '2025-08-15T10' AS export_hour, TRUE AS stamped FROM events""",
    "stamp_bronze": "SELECT event_id AS trip_id, 'validated' AS data_quality_status, TRUE AS stamped FROM events",
    "trip_duration": f"{_WITH_FLAGGED} SELECT trip_id, round(trip_duration_minutes, 8) AS trip_duration_minutes FROM bronze",
    "valid_trip_flag": f"{_WITH_FLAGGED} SELECT trip_id, is_valid_trip FROM flagged",
    "valid_trip_filter": f"{_WITH_FLAGGED} SELECT {TRIP_COLS} FROM flagged WHERE is_valid_trip",
    "distance_category": f"""{_WITH_TRIPS} SELECT trip_id, CASE WHEN trip_distance <= 2 THEN 'short'
        WHEN trip_distance <= 10 THEN 'medium' ELSE 'long' END AS distance_category FROM trips""",
    "fare_per_mile": f"""{_WITH_TRIPS} SELECT trip_id, round(CASE WHEN trip_distance > 0
        THEN fare_amount / trip_distance ELSE 0 END, 8) AS fare_per_mile FROM trips""",
    "pickup_calendar": f"""{_WITH_TRIPS} SELECT trip_id, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
        CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS pickup_day_of_week,
        dayofweek(tpep_pickup_datetime) IN (0, 6) AS is_weekend FROM trips""",
    "time_period": f"""{_WITH_TRIPS} SELECT trip_id, CASE WHEN hour(tpep_pickup_datetime) BETWEEN 6 AND 11 THEN 'morning'
        WHEN hour(tpep_pickup_datetime) BETWEEN 12 AND 17 THEN 'afternoon'
        WHEN hour(tpep_pickup_datetime) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS time_period FROM trips""",
    "hour_trunc": f"{_WITH_TRIPS} SELECT trip_id, date_trunc('hour', tpep_pickup_datetime) AS pickup_hour_window FROM trips",
    "timestamp_parts": f"""{_WITH_TRIPS}, moved AS (SELECT {shifted('tpep_pickup_datetime', 2025, 9)} FROM trips)
        SELECT DISTINCT CAST(year(tpep_pickup_datetime) AS INTEGER) AS pickup_year,
               CAST(month(tpep_pickup_datetime) AS INTEGER) AS pickup_month,
               CAST(day(tpep_pickup_datetime) AS INTEGER) AS pickup_day,
               CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour FROM moved""",
    "expect_warn": f"""{_WITH_TRIPS} SELECT trip_id, pickup_zip, dropoff_zip,
        coalesce(pickup_zip > 0 AND dropoff_zip > 0, FALSE) AS passed FROM trips""",
    "expect_drop": f"{_WITH_TRIPS} SELECT {TRIP_COLS} FROM trips WHERE {_CLEAN}",
    "expect_fail": _WITH_TRIPS + """ SELECT rule, failed AS violations, (SELECT sum(failed) > 0 FROM broken) AS aborted,
        CASE WHEN (SELECT sum(failed) FROM broken) = 0 THEN (SELECT count(*) FROM trips WHERE fare_amount < 1000) ELSE 0 END
        AS rows_published FROM broken""".replace(" SELECT rule", ", broken AS (" + rules_sql(
        [r for r in STREAM_RULES_SQL if r[1] == Q.FAIL]) + ") SELECT rule", 1),
    "expect_set": f"{_WITH_TRIPS} SELECT {TRIP_COLS} FROM trips WHERE {_CLEAN} AND fare_amount < 100",
    "quality_rules_trip": _WITH_TRIPS + rules_sql(STREAM_RULES_SQL + BATCH_RULES_SQL),
    "expectation_report": _WITH_TRIPS + rules_sql(STREAM_RULES_SQL, "batch_id"),
    "last_user_message": """SELECT conv_id, max(turn) AS turn,
        CAST(conv_id AS VARCHAR) || ':' || CAST(max(turn) AS VARCHAR) AS anchor_message_id
        FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "quality_metrics": f"""{_WITH_TRIPS} SELECT count(*) AS total_records,
        count(DISTINCT pickup_zip) AS distinct_pickup_zips, count(DISTINCT dropoff_zip) AS distinct_dropoff_zips,
        round(avg(trip_distance), 8) AS avg_trip_distance, round(avg(fare_amount), 8) AS avg_fare_amount,
        min(tpep_pickup_datetime) AS earliest_pickup, max(tpep_pickup_datetime) AS latest_pickup
        FROM trips WHERE {_CLEAN}""",
    "hourly_summary": f"""{_WITH_TRIPS} SELECT date_trunc('hour', tpep_pickup_datetime) AS pickup_hour,
        count(*) AS trips_per_hour, round(avg(trip_distance), 8) AS avg_distance,
        round(avg(fare_amount), 8) AS avg_fare, count(DISTINCT pickup_zip) AS unique_pickup_zones
        FROM trips WHERE {_CLEAN} GROUP BY 1 ORDER BY 1""",
    "gold_hourly": f"WITH {SILVER_CTE}" + GOLD_SELECT.format(where=""),
    "hour_of_day_trips": f"""{_WITH_TRIPS} SELECT CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
        count(*) AS trip_count, round(avg(fare_amount), 8) AS avg_fare
        FROM trips WHERE {_CLEAN} GROUP BY 1 ORDER BY 1""",
    "top_zips": f"""{_WITH_TRIPS} SELECT pickup_zip, count(*) AS trip_count, round(avg(trip_distance), 8) AS avg_distance
        FROM trips WHERE {_CLEAN} GROUP BY pickup_zip ORDER BY trip_count DESC, pickup_zip LIMIT 10""",
    "source_coverage": f"""{_WITH_TRIPS} SELECT CAST(day(tpep_pickup_datetime) AS INTEGER) AS "day",
        CAST(hour(tpep_pickup_datetime) AS INTEGER) AS "hour", count(*) AS records FROM trips
        WHERE year(tpep_pickup_datetime) = 2024 AND month(tpep_pickup_datetime) IN (1, 2) GROUP BY 1, 2 ORDER BY 1, 2""",
    "row_count_check": "SELECT count(*) AS row_count, count(*) > 5 AS passed FROM events",
}
