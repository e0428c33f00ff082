"""Batch writer and layer sink."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ExportedBatch:
    path: str
    rows: int


def batch_name(moment: datetime, suffix: str | None = None) -> str:
    """``taxi_batch_<YYYYmmdd_HHMMSS>_<8 hex>.parquet``."""
    suffix = suffix or uuid.uuid4().hex[:8]
    return f"taxi_batch_{moment:%Y%m%d_%H%M%S}_{suffix}.parquet"


def export_batch(df: DataFrame, landing: str, moment: datetime,
                 suffix: str | None = None) -> ExportedBatch:
    """Write one batch and report its path and row count.

    The count is taken from the footers of the written files, so the plan runs
    once.  (An ``Observation`` would do too, but it leaves a manager in the
    session that MLlib models cannot be shipped with.)
    """
    path = f"{landing.rstrip('/')}/{batch_name(moment, suffix)}"
    df.write.mode("overwrite").parquet(path)
    return ExportedBatch(path, df.sparkSession.read.schema(df.schema).parquet(path).count())


@dataclass(frozen=True)
class Layer:
    """Where a layer lives and what it is labelled."""

    name: str
    root: str
    quality: str

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/_checkpoints/{self.name}"


def write_layer(df: DataFrame, layer: Layer) -> DataFrame:
    """Recompute a layer and return the stored table.

    The stored table also cuts the lineage: what reads it survives the loss of
    the executors that computed it.
    """
    df.write.mode("overwrite").parquet(layer.path)
    return df.sparkSession.read.schema(df.schema).parquet(layer.path)
