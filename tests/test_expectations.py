import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from mileglass.operators import expectations as Q
from tests.test_trips import TRIP, trip


@pytest.fixture
def good(spark):
    return [trip(), trip(fare=999.99), trip(distance=0.0)]


def report(df, rules):
    return {r.rule: (r.passed, r.failed) for r in Q.report(df, rules).collect()}


@pytest.mark.parametrize("bad", [
    trip(pickup=None), trip(dropoff=None), trip(distance=-1.0), trip(distance=None),
    trip(fare=0.0), trip(fare=-5.0), trip(fare=None)])
def test_fail_rules_raise(spark, good, bad):
    with pytest.raises(Q.ExpectationFailed):
        Q.apply(spark.createDataFrame([*good, bad], TRIP), Q.STREAM_TRIP_RULES)


def test_drop_and_warn_rules(spark, good):
    # A session of its own, as the observation stays with it.
    df = spark.newSession().createDataFrame([*good, trip(fare=1000.0), trip(zip1=0), trip(zip2=None)], TRIP)
    seen = Observation()
    kept = Q.apply(df, Q.STREAM_TRIP_RULES, seen)
    assert kept.count() == 5
    assert seen.get == {"reasonable_fare": 1, "valid_zip_codes": 2}
    assert report(df, Q.STREAM_TRIP_RULES)["valid_zip_codes"] == (4, 2)


def test_null_is_a_violation(spark):
    df = spark.createDataFrame([trip(distance=None), trip(distance=1.0)], TRIP)
    rule = Q.expect_drop("far", "trip_distance > 0")
    assert Q.drop_violations(df, [rule]).count() == 1
    assert report(df, [rule]) == {"far": (1, 1)}


def test_column_rules(spark):
    df = spark.createDataFrame([trip(), trip(dropoff="2016-01-05 10:00:00"), trip(distance=0.0), trip(fare=0.0)], TRIP)
    assert Q.drop_violations(df, Q.batch_trip_rules()).count() == 1
    assert set(report(df, Q.batch_trip_rules()).values()) == {(3, 1)}


def test_unknown_action():
    with pytest.raises(ValueError):
        Q.Expectation("x", "true", "ignore")


def test_check_sees_rows_a_later_filter_would_skip(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select(F.col("id"), (F.col("id") < 1000).alias("ok"))
    rows.write.parquet(path)
    df = spark.read.parquet(path)
    with pytest.raises(Q.ExpectationFailed):
        Q.apply(df, [Q.expect_fail("ok", "ok")]).filter("id < 1000").count()


def test_publish(spark, tmp_path):
    rules = [Q.expect_fail("id", "id IS NOT NULL"), Q.expect_fail("v", "v >= 0"), Q.expect_drop("small", "v < 10")]
    good = spark.createDataFrame([(1, 1), (2, 50), (3, None)], "id int, v int").filter("v IS NOT NULL")
    bad = spark.createDataFrame([(1, -1), (None, -2), (3, 3)], "id int, v int")
    root = str(tmp_path / "table")
    assert Q.published(spark, root, good.schema).count() == 0
    assert sorted(map(tuple, Q.publish(bad, rules, root).collect())) == [("id", 1, True, 0), ("v", 2, True, 0)]
    assert Q.published(spark, root, good.schema).count() == 0  # discarded
    assert sorted(map(tuple, Q.publish(good, rules, root).collect())) == [("id", 0, False, 1), ("v", 0, False, 1)]
    assert [tuple(r) for r in Q.published(spark, root, good.schema).collect()] == [(1, 1)]
    Q.publish(bad, rules, root)
    assert [tuple(r) for r in Q.published(spark, root, good.schema).collect()] == [(1, 1)]  # the version before stays
    Q.publish(good.withColumn("id", F.col("id") + 1), rules, root)
    assert [tuple(r) for r in Q.published(spark, root, good.schema).collect()] == [(2, 1)]


def test_metrics_survive_a_replay(spark, tmp_path):
    rules = [Q.expect_warn("positive", "v > 0")]
    rows = spark.createDataFrame([("a", 1), ("a", -1), ("b", 2)], "batch_id string, v int")
    path = str(tmp_path / "metrics")
    first = sorted(map(tuple, Q.record_metrics(rows, rules, path).collect()))
    assert first == [("a", "positive", "warn", 1, 1), ("b", "positive", "warn", 1, 0)]
    for part in (rows.filter("batch_id = 'a'"), rows):
        assert sorted(map(tuple, Q.record_metrics(part, rules, path).collect())) == first
    more = Q.record_metrics(spark.createDataFrame([("c", 1)], rows.schema), rules, path)
    assert sorted(map(tuple, more.collect())) == [*first, ("c", "positive", "warn", 1, 0)]
