from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mileglass import schema as S
from mileglass.operators import layers as L
from mileglass.plans import medallion
from mileglass.sources.adapters import trips
from mileglass.streaming.layers import TripLayers


@pytest.fixture(scope="module")
def exported(spark, sf_dir):
    """Trips in export form, as a batch table."""
    df = trips(spark, sf_dir).filter("fare_amount > 0")
    return (df.withColumn("export_timestamp", F.lit(datetime(2024, 4, 1)))
            .withColumn("source_system", F.lit(S.EXPORT_SOURCE)).select(*S.EXPORTED_BATCH.fieldNames()))


def stage(exported, landing, parts=4):
    """Write batches in pickup order, one after the other."""
    days = [F.floor(F.dayofyear(S.PICKUP) * parts / 62) == i for i in range(parts)]
    for i, day in enumerate(days):
        exported.filter(day).coalesce(1).write.parquet(f"{landing}/b{i}.parquet")


def as_set(df):
    cols = sorted(set(df.columns) - set(S.LINEAGE))
    return {tuple(r) for r in df.select(*[F.round(c, 6) if t == "double" else c for c, t in
                                          sorted(df.dtypes) if c in cols]).collect()}


def test_stream_equals_batch_on_closed_windows(spark, exported, tmp_path):
    stage(exported, tmp_path / "landing")
    layers = TripLayers(spark, str(tmp_path / "out"), max_files=1)
    gold = layers.run_all(layers.landing_stream(str(tmp_path / "landing")))
    silver = spark.read.parquet(layers.silver.path)
    last = silver.agg(F.max(S.PICKUP)).first()[0]
    expected = medallion.gold_from_trips(exported)
    closed = expected.filter(F.col("pickup_hour_window") + F.expr("interval 1 hour")
                             <= F.lit(last) - F.expr("interval 10 minutes"))
    assert as_set(gold) == as_set(closed)
    assert expected.count() > gold.count() > 0.95 * expected.count()


def test_many_files_in_mixed_order_lose_nothing(spark, exported, tmp_path):
    """More files than a trigger takes, in no order of time, and one task for each file."""
    mixed = exported.withColumn("part", F.pmod(F.xxhash64(S.PICKUP, "trip_distance"), F.lit(24))).cache()
    for i in range(24):
        mixed.filter(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{tmp_path}/many/b{i}.parquet")
    exported.coalesce(1).write.parquet(f"{tmp_path}/one/b0.parquet")
    found, before = {}, {k: spark.conf.get(k, None) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        for name in ("one", "many"):
            layers = TripLayers(spark, str(tmp_path / f"out-{name}"))
            gold = layers.run_all(layers.landing_stream(str(tmp_path / name)))
            found[name] = (spark.read.parquet(layers.landing.path).count(), as_set(spark.read.parquet(layers.silver.path)),
                           as_set(gold))
        files = len(spark.read.parquet(f"{tmp_path}/out-many/silver").inputFiles())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert files > S.MAX_FILES_PER_TRIGGER
    assert found["one"] == found["many"]


def test_files_are_processed_once_across_restarts(spark, exported, tmp_path):
    stage(exported, tmp_path / "landing", 2)
    run = lambda: (lambda x: x.run_to_silver(x.landing_stream(str(tmp_path / "landing"))))(
        TripLayers(spark, str(tmp_path / "out")))
    first = run().count()
    assert run().count() == first
    exported.limit(50).coalesce(1).write.parquet(str(tmp_path / "landing/b9.parquet"))
    again = run()
    assert again.count() == first + L.silver(L.bronze(exported.limit(50))).count()
    landed = spark.read.parquet(str(tmp_path / "out/landing"))
    assert landed.count() == exported.count() + 50
    assert landed.filter("dlt_file_path is null or dlt_load_timestamp is null").count() == 0


def test_fail_rule_stops_the_stream_and_publishes_nothing(spark, exported, tmp_path):
    bad = exported.withColumn("fare_amount", F.when(F.col("pickup_zip") == 10003, -1.0).otherwise(F.col("fare_amount")))
    bad.coalesce(1).write.parquet(str(tmp_path / "landing/b0.parquet"))
    layers = TripLayers(spark, str(tmp_path / "out"))
    landed = layers.run_landing(layers.landing_stream(str(tmp_path / "landing")))
    with pytest.raises(Exception, match="expectation failed"):
        layers.run_bronze(landed.schema)
    logs = list((tmp_path / "out/bronze/_spark_metadata").glob("[0-9]*"))
    assert logs == []


def test_drop_rule_counts_are_in_the_progress(spark, exported, tmp_path):
    rows = exported.withColumn("fare_amount", F.when(F.col("pickup_zip") == 10003, 1000.0).otherwise(F.col("fare_amount")))
    rows.coalesce(1).write.parquet(str(tmp_path / "landing/b0.parquet"))
    layers = TripLayers(spark, str(tmp_path / "out"))
    landed = layers.run_landing(layers.landing_stream(str(tmp_path / "landing")))
    over = rows.filter("fare_amount >= 1000").count()
    assert over > 0
    assert layers.run_bronze(landed.schema).count() == rows.count() - over
