"""Declared schemas and fixed names of the trip tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, types and labels every layer agrees on.
PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"

TRIP = T.StructType([
    T.StructField(PICKUP, T.TimestampType()),
    T.StructField(DROPOFF, T.TimestampType()),
    T.StructField("trip_distance", T.DoubleType()),
    T.StructField("fare_amount", T.DoubleType()),
    T.StructField("pickup_zip", T.IntegerType()),
    T.StructField("dropoff_zip", T.IntegerType()),
])

EXPORTED_BATCH = T.StructType(TRIP.fields + [
    T.StructField("export_timestamp", T.TimestampType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("source_system", T.StringType()),
    T.StructField("export_hour", T.StringType()),
])

RAW_LANDING = T.StructType(EXPORTED_BATCH.fields + [
    T.StructField("dlt_load_timestamp", T.TimestampType()),
    T.StructField("dlt_file_path", T.StringType()),
])

TRIP_COLUMNS = TRIP.fieldNames()
LANDING_STAMPS = ["ingestion_timestamp", "source_system", "data_quality_flag"]
BATCH_STAMPS = ["export_timestamp", "batch_id", "source_system", "export_hour"]
LINEAGE = ["dlt_load_timestamp", "dlt_file_path"]

SIMULATION_SOURCE = "nyc_taxi_simulation"
EXPORT_SOURCE = "nyc_taxi_export"
LANDING_FLAG = "pending_validation"
BRONZE_STATUS = "validated"

SOURCE_YEAR = 2016
SOURCE_MONTHS = (1, 2)
SAMPLE_FRACTION = 0.75
SAMPLE_SEED = 42
MAX_FILES_PER_TRIGGER = 10
WATERMARK = "10 minutes"
