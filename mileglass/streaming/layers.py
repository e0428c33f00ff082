"""Layers as chained append-only streaming queries.

Each layer is one query with one checkpoint.  The file sink's own log makes a
layer exactly-once, and the next layer reads through that log.  Nothing is
collected, and a lost executor only repeats its tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mileglass import schema as S
from mileglass.operators import layers as L
from mileglass.operators.expectations import STREAM_TRIP_RULES, Expectation, guard_stream
from mileglass.sources.batches import Layer
from mileglass.sources.tables import stream_files, with_lineage


def start_layer(df: DataFrame, layer: Layer, processing_time: str | None = None) -> StreamingQuery:
    """Append a stream to a layer; by default stop when the input is used up."""
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (df.writeStream.format("parquet").outputMode("append")
            .option("path", layer.path)
            .option("checkpointLocation", layer.checkpoint)
            .trigger(**trigger).start())


def run_layer(df: DataFrame, layer: Layer) -> DataFrame:
    """Bring a layer up to date and return what it holds."""
    query = start_layer(df, layer)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(layer.path)


def read_layer_stream(spark: SparkSession, layer: Layer, schema: T.StructType) -> DataFrame:
    """A layer as the stream input of the next one.

    All new files of the layer are one batch.  Were they cut into several, the first would move the watermark of an
    event-time aggregation to its latest time, and rows of the others would be thrown away as late.
    """
    return spark.readStream.schema(schema).parquet(layer.path)


class TripLayers:
    """Landing, bronze, silver and gold below one root folder.

    Each ``run_*`` method processes what is new since its last call, also
    after a restart, and returns the stored layer.  ``max_files`` limits the
    files of one trigger at the landing source only, which has no state.

    The file sinks keep a log of every file they wrote; set
    ``spark.sql.streaming.fileSink.log.cleanupDelay`` and the ``retention``
    option of the sink to the time a reader may need to catch up.
    """

    def __init__(self, spark: SparkSession, root: str,
                 rules: Sequence[Expectation] = STREAM_TRIP_RULES,
                 max_files: int = S.MAX_FILES_PER_TRIGGER):
        self.spark = spark
        self.rules = rules
        self.max_files = max_files
        self.landing = Layer("landing", root, "bronze")
        self.bronze = Layer("bronze", root, "bronze")
        self.silver = Layer("silver", root, "silver")
        self.gold = Layer("gold", root, "gold")

    def landing_stream(self, path: str, schema: T.StructType = S.EXPORTED_BATCH) -> DataFrame:
        return with_lineage(stream_files(self.spark, path, schema, self.max_files))

    def run_landing(self, stream: DataFrame) -> DataFrame:
        return run_layer(stream, self.landing)

    def run_bronze(self, schema: T.StructType) -> DataFrame:
        typed = L.bronze(read_layer_stream(self.spark, self.landing, schema))
        return run_layer(guard_stream(typed, self.rules, "bronze_rules"), self.bronze)

    def run_silver(self, schema: T.StructType) -> DataFrame:
        return run_layer(
            L.silver(read_layer_stream(self.spark, self.bronze, schema)), self.silver)

    def run_gold(self, schema: T.StructType) -> DataFrame:
        return run_layer(
            L.gold_hourly(read_layer_stream(self.spark, self.silver, schema)), self.gold)

    def run_to_silver(self, stream: DataFrame) -> DataFrame:
        landed = self.run_landing(stream)
        cleaned = self.run_bronze(landed.schema)
        return self.run_silver(cleaned.schema)

    def run_all(self, stream: DataFrame) -> DataFrame:
        return self.run_gold(self.run_to_silver(stream).schema)
