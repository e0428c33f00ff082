"""Scalar trip measures as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (inclusive) of the bands, and one label more than bounds.
DISTANCE_BOUNDS, DISTANCE_LABELS = (2, 10), ("short", "medium", "long")
HOUR_BOUNDS, HOUR_LABELS = (5, 11, 17, 22), ("night", "morning", "afternoon", "evening", "night")
WEEKEND = (1, 7)  # Sunday and Saturday
LONGEST_MINUTES = 600.0


def band(value: Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the band a value lies in; ``bounds`` rise, and a NULL lies beyond all of them."""
    above = sum(((value > b).cast("int") for b in bounds), F.lit(0))
    return F.coalesce(F.get(F.array(*map(F.lit, labels)), above), F.lit(labels[-1]))


def duration_minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps, each taken at whole seconds."""
    return (end.cast("long") - start.cast("long")) / F.lit(60.0)


def is_valid_duration(minutes: Column, longest: float = LONGEST_MINUTES) -> Column:
    """Strictly between zero and ``longest`` minutes; NULL is not valid."""
    return F.coalesce((minutes > 0) & (minutes < longest), F.lit(False))


def distance_category(distance: Column) -> Column:
    return band(distance, DISTANCE_BOUNDS, DISTANCE_LABELS)


def fare_per_mile(fare: Column, distance: Column) -> Column:
    """Zero for trips without a distance."""
    return F.when(distance > 0, fare / distance).otherwise(F.lit(0.0))


def is_weekend(day_of_week: Column) -> Column:
    return F.coalesce(day_of_week.isin(*WEEKEND), F.lit(False))


def time_period(hour: Column) -> Column:
    return band(hour, HOUR_BOUNDS, HOUR_LABELS)
