"""Calendar slices, samples and month shifts of historical rows."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mileglass import schema as S
from mileglass.functions.calendar import in_calendar_hour, moved_to_month
from mileglass.functions.hashing import hash_fraction


def calendar_slice(df: DataFrame, *, day: int, hour: int, year: int = S.SOURCE_YEAR,
                   months: Iterable[int] = S.SOURCE_MONTHS, on: str = S.PICKUP) -> DataFrame:
    """Rows of one day of the month and hour in the given months of a year."""
    return df.filter(in_calendar_hour(F.col(on), year=year, months=months, day=day, hour=hour))


def shift_to_month(df: DataFrame, *, year: int, month: int, source_year: int = S.SOURCE_YEAR,
                   source_months: Iterable[int] = S.SOURCE_MONTHS,
                   columns: Iterable[str] = (S.PICKUP, S.DROPOFF)) -> DataFrame:
    """Move timestamps to a target month; each column by its own month."""
    return df.withColumns({
        c: moved_to_month(F.col(c), source_year=source_year, source_months=tuple(source_months),
                          year=year, month=month)
        for c in columns
    })


def sample_rows(df: DataFrame, fraction: float = S.SAMPLE_FRACTION, seed: int = S.SAMPLE_SEED,
                by_hash: str | None = None) -> DataFrame:
    """A Bernoulli sample, or with ``by_hash`` one fixed by that key column."""
    if by_hash is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.filter(hash_fraction(F.col(by_hash), fraction, seed))


def previous_hour_slice(df: DataFrame, as_of: datetime, *, source_year: int = S.SOURCE_YEAR,
                        source_months: Iterable[int] = S.SOURCE_MONTHS,
                        fraction: float | None = S.SAMPLE_FRACTION,
                        by_hash: str | None = None) -> DataFrame:
    """History for the hour before ``as_of``, sampled and moved to its month.

    ``fraction=None`` keeps every row.
    """
    target = as_of - timedelta(hours=1)
    sliced = calendar_slice(df, day=target.day, hour=target.hour, year=source_year,
                            months=source_months)
    if fraction is not None:
        sliced = sample_rows(sliced, fraction, by_hash=by_hash)
    return shift_to_month(sliced, year=target.year, month=target.month,
                          source_year=source_year, source_months=source_months)


def timestamp_parts(df: DataFrame, on: str = S.PICKUP) -> DataFrame:
    """Distinct year, month, day and hour of a timestamp column."""
    ts = F.col(on)
    return df.select(F.year(ts).alias("pickup_year"), F.month(ts).alias("pickup_month"),
                     F.dayofmonth(ts).alias("pickup_day"), F.hour(ts).alias("pickup_hour")).distinct()
