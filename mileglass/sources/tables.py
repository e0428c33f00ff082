"""Scans, previews, file lineage and the file stream source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mileglass import schema as S


def scan_table(spark: SparkSession, location: str) -> DataFrame:
    """Full scan of a catalog table name or of a parquet location."""
    if "/" in location or location.endswith(".parquet"):
        return spark.read.parquet(location)
    return spark.read.table(location)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/{name}.parquet")


def preview(df: DataFrame, n: int = 10, order_by: str | None = None) -> DataFrame:
    """The first n rows; with ``order_by`` a per-task top n, no full sort."""
    return (df.orderBy(order_by) if order_by else df).limit(n)


def with_lineage(df: DataFrame) -> DataFrame:
    """Stamp each row with its load time and the file it came from."""
    return (df.withColumn("dlt_load_timestamp", F.current_timestamp())
            .withColumn("dlt_file_path", F.col("_metadata.file_path")))


def stream_files(spark: SparkSession, path: str, schema: T.StructType,
                 max_files: int | None = S.MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Parquet files as a stream: existing files first, then new arrivals.

    ``path`` may be a folder (searched in depth, since a batch is itself a
    folder of part files) or a glob pattern.  ``max_files`` is for stateless
    streams; give None where event time is aggregated, since a first trigger
    with late times would make the files of later triggers late.
    """
    reader = spark.readStream.format("parquet").schema(schema).option("recursiveFileLookup", "true")
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).load(path)
