"""The batch plans: historical slice to landing, bronze and reports."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from mileglass import schema as S
from mileglass.operators import layers as L
from mileglass.operators.expectations import STREAM_TRIP_RULES, apply, batch_trip_rules, drop_violations
from mileglass.operators.slicing import previous_hour_slice
from mileglass.operators.stamps import cast_schema, require_columns, stamp_batch, stamp_landing
from mileglass.sources.batches import ExportedBatch, export_batch


def simulated_hour(source: DataFrame, as_of: datetime, *, source_year: int = S.SOURCE_YEAR,
                   source_months: Iterable[int] = S.SOURCE_MONTHS,
                   fraction: float | None = S.SAMPLE_FRACTION) -> DataFrame:
    """History for the hour of ``as_of`` in landing form."""
    rows = previous_hour_slice(source, as_of + timedelta(hours=1), source_year=source_year,
                               source_months=source_months, fraction=fraction)
    return require_columns(stamp_landing(cast_schema(rows)))


def bronze_batch(landing: DataFrame) -> DataFrame:
    """Landing rows that meet the three drop rules, typed and stamped."""
    return drop_violations(L.bronze_from_landing(landing), batch_trip_rules())


def export_previous_hour(source: DataFrame, landing: str, as_of: datetime, *,
                         source_year: int = S.SOURCE_YEAR,
                         source_months: Iterable[int] = S.SOURCE_MONTHS,
                         fraction: float | None = S.SAMPLE_FRACTION, by_hash: str | None = None,
                         batch_id: str | None = None) -> ExportedBatch:
    """Write the hour before ``as_of`` as one stamped batch; ``by_hash`` names the key that fixes the sample."""
    rows = previous_hour_slice(source, as_of, source_year=source_year,
                               source_months=source_months, fraction=fraction, by_hash=by_hash)
    stamped = stamp_batch(rows, as_of - timedelta(hours=1), batch_id)
    return export_batch(stamped.select(*S.TRIP_COLUMNS, *S.BATCH_STAMPS), landing, as_of)


def gold_from_trips(trips: DataFrame) -> DataFrame:
    """Bronze, silver and hourly gold of a batch of trips in one plan."""
    return L.gold_hourly(L.silver(drop_violations(L.bronze(trips), STREAM_TRIP_RULES)))


def checked_gold_from_trips(trips: DataFrame) -> DataFrame:
    """As above, but fail rules are checked before anything is computed."""
    return L.gold_hourly(L.silver(apply(L.bronze(trips), STREAM_TRIP_RULES)))
