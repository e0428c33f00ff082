"""Row expectations that warn, drop or fail.

A rule holds for a row only if its condition is TRUE, so NULL is a violation.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

WARN, DROP, FAIL = "warn", "drop", "fail"
_KEPT, _BROKEN = "_kept", "_broken"


class ExpectationFailed(RuntimeError):
    """Raised when rows violate a rule whose action is ``fail``."""


@dataclass(frozen=True)
class Expectation:
    name: str
    condition: str | Column
    action: str

    def __post_init__(self):
        if self.action not in (WARN, DROP, FAIL):
            raise ValueError(f"unknown action {self.action!r}")

    @property
    def holds(self) -> Column:
        test = F.expr(self.condition) if isinstance(self.condition, str) else self.condition
        return F.coalesce(test, F.lit(False))


def expect_warn(name: str, condition: str | Column) -> Expectation:
    return Expectation(name, condition, WARN)


def expect_drop(name: str, condition: str | Column) -> Expectation:
    return Expectation(name, condition, DROP)


def expect_fail(name: str, condition: str | Column) -> Expectation:
    return Expectation(name, condition, FAIL)


# The rule sets of the two trip pipelines.
STREAM_TRIP_RULES = (
    expect_fail("valid_pickup_datetime", "tpep_pickup_datetime IS NOT NULL"),
    expect_fail("valid_dropoff_datetime", "tpep_dropoff_datetime IS NOT NULL"),
    expect_fail("valid_trip_distance", "trip_distance >= 0"),
    expect_fail("valid_fare_amount", "fare_amount > 0"),
    expect_drop("reasonable_fare", "fare_amount < 1000"),
    expect_warn("valid_zip_codes", "pickup_zip > 0 AND dropoff_zip > 0"),
)


def batch_trip_rules() -> tuple[Expectation, ...]:
    """Three drop rules given as Columns (which need a running session)."""
    pickup, dropoff = F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime")
    return (
        expect_drop("valid_timestamps",
                    pickup.isNotNull() & dropoff.isNotNull() & (dropoff > pickup)),
        expect_drop("valid_trip_distance", F.col("trip_distance") > 0),
        expect_drop("valid_fare_amount", F.col("fare_amount") > 0),
    )


def _all_hold(rules: Sequence[Expectation]) -> Column:
    return reduce(Column.__and__, (r.holds for r in rules), F.lit(True))


def _with_action(rules: Sequence[Expectation], action: str) -> list[Expectation]:
    return [r for r in rules if r.action == action]


def violation_counts(rules: Sequence[Expectation]) -> list[Column]:
    return [F.count_if(~r.holds).alias(r.name) for r in rules]


def check(df: DataFrame, rules: Sequence[Expectation]) -> None:
    """Count violations of the fail rules and raise before anything is written.

    This is an action of its own.  An error raised inside the row stream of a
    batch plan could be skipped when a later filter reaches the file reader.
    """
    fatal = _with_action(rules, FAIL)
    if fatal:
        found = df.agg(*violation_counts(fatal)).first().asDict()
        broken = {k: v for k, v in found.items() if v}
        if broken:
            raise ExpectationFailed(f"rows violate {broken}")


def drop_violations(df: DataFrame, rules: Sequence[Expectation]) -> DataFrame:
    droppers = _with_action(rules, DROP)
    return df.filter(_all_hold(droppers)) if droppers else df


def apply(df: DataFrame, rules: Sequence[Expectation],
          observation: Observation | None = None) -> DataFrame:
    """Enforce a rule set on a batch table.

    Fail rules are checked now; the violation counts of the others reach
    ``observation`` when the result is computed.  Do not fit MLlib models in a
    session that has used an ``Observation``: its manager cannot be serialized
    with them.
    """
    check(df, rules)
    softer = [r for r in rules if r.action != FAIL]
    if observation is not None and softer:
        df = df.observe(observation, *violation_counts(softer))
    return drop_violations(df, rules)


def guard_stream(df: DataFrame, rules: Sequence[Expectation], name: str) -> DataFrame:
    """Enforce a rule set inside a streaming query, in one pass.

    The counts appear in the query progress under ``name``.  A violated fail
    rule raises in the task, so the micro-batch is never committed and none of
    its rows becomes visible in the file sink.  Use it as the last filter
    before the sink: one CASE keeps the fail test ahead of the drop test, and
    the observation above the scan keeps both out of the file reader.
    """
    fatal = _with_action(rules, FAIL)
    keep = _all_hold(_with_action(rules, DROP))
    names = ", ".join(r.name for r in fatal)
    if fatal:
        keep = (F.when(~_all_hold(fatal),
                       F.raise_error(F.lit(f"expectation failed, one of: {names}")).cast("boolean"))
                .otherwise(keep))
    return df.observe(name, *violation_counts(rules)).filter(keep)


def publish(df: DataFrame, rules: Sequence[Expectation], root: str) -> DataFrame:
    """Write a table version aside, check it there, and publish it only if no row violates a fail rule.

    Returns one row per fail rule: rule, violations, aborted, rows_published.  All rows are written once below
    ``root`` with the rules they violate; a version becomes visible to ``published`` by one small row that names it,
    written last.  An aborted or interrupted version is never named, so readers keep the version before it.
    """
    fatal, path = _with_action(rules, FAIL), f"{root}/versions/{uuid.uuid4().hex}"
    marked = df.withColumns({_KEPT: _all_hold(_with_action(rules, DROP)),
                             _BROKEN: F.array_compact(F.array(*(F.when(~r.holds, F.lit(r.name)) for r in fatal)))})
    marked.write.parquet(path)
    spark = df.sparkSession
    checked = spark.read.schema(marked.schema).parquet(path).agg(
        F.count_if(_KEPT).alias("kept"), *(F.count_if(F.array_contains(_BROKEN, r.name)).alias(f"_r{i}") for i, r in enumerate(fatal))).first()
    violations = [checked[f"_r{i}"] for i in range(len(fatal))]
    aborted = any(violations)
    if not aborted:
        spark.range(1).select(F.current_timestamp().alias("at"), F.lit(path).alias("path"), F.lit(checked["kept"]).alias("n")).write.mode(
            "append").parquet(f"{root}/published")
    return spark.createDataFrame([(r.name, n, aborted, 0 if aborted else checked["kept"]) for r, n in zip(fatal, violations)],
                                 "rule string, violations bigint, aborted boolean, rows_published bigint")


def published(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows of the latest published version; no rows before the first."""
    try:
        latest = spark.read.parquet(f"{root}/published").agg(F.max_by("path", "at")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    marks = [StructField(_KEPT, BooleanType()), StructField(_BROKEN, ArrayType(StringType()))]
    return spark.read.schema(StructType([*schema.fields, *marks])).parquet(latest).filter(_KEPT).drop(_KEPT, _BROKEN)


def record_metrics(df: DataFrame, rules: Sequence[Expectation], path: str, batch: str = "batch_id") -> DataFrame:
    """Add the counts of these rows to the table of rule metrics and return that table.

    One row per batch and rule: batch, rule, action, passed, failed.  A batch replaces what the table held for the
    same batch and touches no other, so a batch that is replayed after a failure is not counted twice.
    """
    found = report(df, rules, by=[batch])
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)
    fields = [f for f in found.schema.fields if f.name != batch] + [found.schema[batch]]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path).select(*found.columns)


def report(df: DataFrame, rules: Sequence[Expectation], by: Sequence[str] = ()) -> DataFrame:
    """One row per rule (and value of ``by``) with the rows that passed and failed, in one pass."""
    total = F.count(F.lit(1)).alias("_total")
    counted = df.groupBy(*by).agg(total, *(F.count_if(~r.holds).alias(f"_r{i}") for i, r in enumerate(rules)))
    rows = F.array(*(
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"),
                 (F.col("_total") - F.col(f"_r{i}")).alias("passed"),
                 F.col(f"_r{i}").alias("failed"))
        for i, r in enumerate(rules)))
    return counted.select(*by, F.inline(rows))
