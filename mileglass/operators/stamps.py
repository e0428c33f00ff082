"""Schema checks and the metadata columns of each layer."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mileglass import schema as S
from mileglass.functions.calendar import hour_label


def cast_schema(df: DataFrame, schema: T.StructType = S.TRIP,
                keep: Iterable[str] = ()) -> DataFrame:
    """Select the declared columns in their declared types, then ``keep``."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema), *keep)


def require_columns(df: DataFrame, required: Iterable[str] = tuple(S.TRIP_COLUMNS),
                    also: Iterable[str] = tuple(S.LANDING_STAMPS)) -> DataFrame:
    """Raise ``ValueError`` if a required column is missing, else project."""
    required = list(required)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.select(*required, *also)


def stamp_landing(df: DataFrame, source_system: str = S.SIMULATION_SOURCE) -> DataFrame:
    return df.withColumns({
        "ingestion_timestamp": F.current_timestamp(),
        "source_system": F.lit(source_system),
        "data_quality_flag": F.lit(S.LANDING_FLAG),
    })


def stamp_batch(df: DataFrame, hour: datetime, batch_id: str | None = None,
                source_system: str = S.EXPORT_SOURCE) -> DataFrame:
    """Stamp export metadata; one id for all rows of the batch."""
    return df.withColumns({
        "export_timestamp": F.current_timestamp(),
        "batch_id": F.lit(batch_id or str(uuid.uuid4())),
        "source_system": F.lit(source_system),
        "export_hour": F.lit(hour_label(hour)),
    })


def stamp_bronze(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "bronze_processing_timestamp": F.current_timestamp(),
        "data_quality_status": F.lit(S.BRONZE_STATUS),
    })
