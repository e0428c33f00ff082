from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mileglass import schema as S
from mileglass.functions import calendar as K
from mileglass.functions import trips as M
from mileglass.operators import layers as L
from mileglass.operators import metrics as R
from mileglass.operators import slicing as C
from mileglass.operators import stamps as P
from mileglass.plans import medallion
from mileglass.plans.trip_queries import QUERIES
from mileglass.sources.adapters import trips
from mileglass.sources.batches import batch_name

TRIP = "tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, trip_distance double, " \
       "fare_amount double, pickup_zip int, dropoff_zip int"


def t(text):
    return datetime.fromisoformat(text)


def trip(pickup="2016-01-05 10:00:00", dropoff="2016-01-05 10:30:00", distance=1.0, fare=5.0, zip1=1, zip2=2):
    return (pickup and t(pickup), dropoff and t(dropoff), distance, fare, zip1, zip2)


def moved(spark, stamps, year, month):
    df = spark.createDataFrame([(t(s),) for s in stamps], "ts timestamp")
    col = K.moved_to_month(F.col("ts"), source_year=2016, source_months=(1, 2), year=year, month=month)
    return [str(r[0]) for r in df.select(col).collect()]


def test_month_ends_clamp_in_two_steps(spark):
    assert moved(spark, ["2016-01-31 08:15:00"], 2025, 2) == ["2025-02-28 08:15:00"]
    # Years first: 29 Feb becomes 28 Feb before the months are added.
    assert moved(spark, ["2016-02-29 23:59:59"], 2025, 9) == ["2025-09-28 23:59:59"]
    assert moved(spark, ["2016-02-10 00:00:00"], 2025, 1) == ["2025-01-10 00:00:00"]
    assert moved(spark, ["2016-03-01 00:00:00"], 2025, 9) == ["2016-03-01 00:00:00"]


def test_each_column_moves_by_its_own_month(spark):
    df = spark.createDataFrame([trip("2016-01-31 23:50:00", "2016-02-01 00:10:00")], TRIP)
    row = C.shift_to_month(df, year=2025, month=9).first()
    assert row.tpep_pickup_datetime == t("2025-09-30 23:50:00")
    assert row.tpep_dropoff_datetime == t("2025-09-01 00:10:00")
    assert not L.with_duration(C.shift_to_month(df, year=2025, month=9)).first().is_valid_trip


def test_slice_keeps_only_the_hour(spark):
    stamps = ["2016-01-05 10:00:00", "2016-01-05 10:59:59", "2016-01-05 11:00:00", "2016-02-05 10:30:00",
              "2016-03-05 10:30:00", "2015-01-05 10:30:00", None]
    df = spark.createDataFrame([trip(s) for s in stamps], TRIP)
    assert C.calendar_slice(df, day=5, hour=10).count() == 3
    assert C.calendar_slice(df, day=31, hour=10).count() == 0
    assert C.calendar_slice(df, day=31, hour=10, months=[2]).count() == 0


def test_slice_reaches_the_file_reader(spark, tmp_path):
    df = spark.createDataFrame([trip()], TRIP)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = C.calendar_slice(stored, day=5, hour=10).select("fare_amount")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(tpep_pickup_datetime" in plan
    assert "pickup_zip" not in plan.split("ReadSchema")[1]


def test_previous_hour_crosses_midnight(spark):
    df = spark.createDataFrame([trip("2016-01-31 23:15:00"), trip("2016-01-01 00:15:00")], TRIP)
    got = C.previous_hour_slice(df, t("2025-08-01 00:30:00"), fraction=None).collect()
    assert [r.tpep_pickup_datetime for r in got] == [t("2025-07-31 23:15:00")]


def test_hash_sample_ignores_partitioning(spark, sf_dir):
    df = trips(spark, sf_dir)
    a = {r[0] for r in C.sample_rows(df, by_hash="trip_id").select("trip_id").collect()}
    b = {r[0] for r in C.sample_rows(df.repartition(7), by_hash="trip_id").select("trip_id").collect()}
    assert a == b and 0.7 < len(a) / df.count() < 0.8
    assert 0.7 < C.sample_rows(df).count() / df.count() < 0.8


def test_boundaries_of_measures(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.01,), (10.0,), (10.01,), (None,), (-1.0,)], "d double")
    got = df.select(M.distance_category(F.col("d")), M.fare_per_mile(F.lit(10.0), F.col("d"))).collect()
    assert [r[0] for r in got] == ["short", "short", "medium", "medium", "long", "long", "short"]
    assert [r[1] for r in got][0] == 0 and got[1][1] == 5 and got[5][1] == 0 and got[6][1] == 0
    hours = spark.createDataFrame([(h,) for h in (5, 6, 11, 12, 17, 18, 22, 23, None)], "h int")
    assert [r[0] for r in hours.select(M.time_period(F.col("h"))).collect()] == [
        "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night", "night"]
    minutes = spark.createDataFrame([(0.0,), (0.5,), (599.9,), (600.0,), (None,)], "m double")
    assert [r[0] for r in minutes.select(M.is_valid_duration(F.col("m"))).collect()] == [
        False, True, True, False, False]
    days = spark.createDataFrame([trip("2025-08-16 10:00:00"), trip("2025-08-17 10:00:00"), trip("2025-08-18 10:00:00")], TRIP)
    assert [(r.pickup_day_of_week, r.is_weekend) for r in L.with_pickup_calendar(days).collect()] == [
        (7, True), (1, True), (2, False)]


def test_required_columns(spark):
    df = P.stamp_landing(spark.createDataFrame([trip()], TRIP))
    assert P.require_columns(df).columns == S.TRIP_COLUMNS + S.LANDING_STAMPS
    with pytest.raises(ValueError, match="fare_amount"):
        P.require_columns(df.drop("fare_amount"))


def test_landing_and_bronze_plan(spark):
    rows = [trip(), trip(distance=0.0), trip(fare=None), trip(dropoff="2016-01-05 10:00:00")]
    landing = medallion.simulated_hour(spark.createDataFrame(rows, TRIP), t("2025-08-05 10:20:00"), fraction=None)
    bronze = medallion.bronze_batch(landing)
    assert landing.count() == 4 and bronze.count() == 1
    assert bronze.first().tpep_pickup_datetime == t("2025-08-05 10:00:00")
    assert bronze.columns == S.TRIP_COLUMNS + ["ingestion_timestamp", "source_system",
                                               "bronze_processing_timestamp", "data_quality_status"]


def test_export_writes_one_batch(spark, tmp_path):
    df = spark.createDataFrame([trip()] * 3, TRIP)
    got = medallion.export_previous_hour(df, str(tmp_path), t("2025-08-05 11:20:00"), fraction=None)
    assert got.rows == 3
    stored = spark.read.parquet(got.path)
    assert stored.columns == S.EXPORTED_BATCH.fieldNames()
    assert stored.select("batch_id", "export_hour").distinct().count() == 1
    assert stored.first().export_hour == "2025-08-05T10"
    assert batch_name(t("2024-12-01 14:30:22"), "a1b2c3d4") == "taxi_batch_20241201_143022_a1b2c3d4.parquet"


def test_exported_batch_is_the_whole_hour(spark, tmp_path):
    rows = [(i, t(f"2024-01-15 10:{i % 60:02d}:00"), i, "view", 5.0, '{"k": 7}')
            for i in range(0, 240, 2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["export_batch"](spark, str(tmp_path)).collect()
    assert len(got) == 120 and {r.written_rows for r in got} == {120}


def test_metrics_of_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], TRIP)
    assert R.quality_metrics(empty).first().total_records == 0
    df = spark.createDataFrame([trip(zip1=None), trip(zip1=None, distance=None)], TRIP)
    row = R.quality_metrics(df).first()
    assert (row.total_records, row.distinct_pickup_zips, row.avg_trip_distance) == (2, 0, 1.0)


def test_gold_has_no_join_and_one_shuffle(spark, sf_dir):
    plan = medallion.gold_from_trips(trips(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "partial_count" in plan
