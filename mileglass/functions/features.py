"""Column expressions of the preparation recipe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_flag(value: Column) -> Column:
    """1 where the value is missing, else 0."""
    return value.isNull().cast("int")


def null_where(value: Column, impossible: Column) -> Column:
    """NULL where the value cannot be true; a NULL test leaves the value."""
    return F.when(F.coalesce(impossible, F.lit(False)), None).otherwise(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0))


def combo_flag(*conditions: Column) -> Column:
    """1 where all conditions hold at once; a NULL condition does not hold."""
    return F.coalesce(reduce(Column.__and__, conditions), F.lit(False)).cast("int")
