"""Calendar predicates and month shifts as Column expressions."""

from __future__ import annotations

import calendar
from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_calendar_hour(ts: Column, *, year: int, months: Iterable[int], day: int, hour: int) -> Column:
    """True for rows in the given day and hour of any of the given months.

    Written as one half-open time range per month.  A parquet reader can skip
    row groups by ranges, which it cannot do for ``hour(ts) = ...``.  A month
    without that day contributes nothing.
    """
    ranges = []
    for month in sorted(set(months)):
        if day <= calendar.monthrange(year, month)[1]:
            start = datetime(year, month, day, hour)
            end = start + timedelta(hours=1)
            ranges.append((ts >= _timestamp(start)) & (ts < _timestamp(end)))
    return reduce(Column.__or__, ranges) if ranges else F.lit(False)


def _timestamp(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def moved_to_month(ts: Column, *, source_year: int, source_months: Iterable[int],
                   year: int, month: int) -> Column:
    """Move a timestamp to ``year``/``month``, keeping day and time of day.

    Only the listed source months move.  The year step comes first and the
    month step second, and each clamps to the end of the month it lands in.
    """
    moved = None
    years = F.make_ym_interval(F.lit(year - source_year))
    for source in source_months:
        target = ts + years + F.make_ym_interval(F.lit(0), F.lit(month - source))
        here = F.month(ts) == source
        moved = F.when(here, target) if moved is None else moved.when(here, target)
    return ts if moved is None else moved.otherwise(ts)


def hour_label(moment: datetime) -> str:
    """``YYYY-MM-DDTHH``."""
    return moment.strftime("%Y-%m-%dT%H")
