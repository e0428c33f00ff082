"""Views of the given tables in the shapes the operators expect.

All views are row-local: no shuffle, no grouping, work proportional to the
table read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mileglass.sources.tables import driver_table


def trips_from_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trip rows out of event rows; works on batch and streaming input."""
    base = events.select(
        F.col("event_id").alias("trip_id"),
        (F.col("ts").cast("timestamp")
         + F.expr("interval 31 days * (event_id % 2)")).alias("tpep_pickup_datetime"),
        F.col("user_id"), F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        *keep,
    )
    return base.select(
        "trip_id",
        "tpep_pickup_datetime",
        (F.col("tpep_pickup_datetime")
         + F.expr("interval 1 minute * (10 * k - 60)")).alias("tpep_dropoff_datetime"),
        (F.col("k") / F.lit(4.0)).alias("trip_distance"),
        F.col("value").alias("fare_amount"),
        F.when(F.col("user_id") == 0, 0).otherwise(10000 + F.col("user_id"))
        .cast("int").alias("pickup_zip"),
        (10000 + (F.col("trip_id") * 7) % 150).cast("int").alias("dropoff_zip"),
        F.date_format("tpep_pickup_datetime", "yyyy-MM-dd'T'HH").alias("export_hour"),
        F.concat(F.lit("b"), (F.col("trip_id") % 3).cast("string")).alias("batch_id"),
        *keep,
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_events(driver_table(spark, sf_dir, "events"))


def staff_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profiling frame: groups, a value missing more in one group, numeric
    text and impossible values, all by key rule."""
    c = driver_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("person_id"),
        F.col("c_mktsegment").alias("department"),
        F.when((F.col("c_mktsegment") == "BUILDING") & (key % 4 == 0), None)
        .when(key % 40 == 7, None)
        .otherwise(F.col("c_acctbal")).alias("training_hours"),
        F.col("c_acctbal").cast("string").alias("monthly_income"),
        F.when(key % 50 == 3, -1).otherwise(20 + key % 45).cast("int").alias("age"),
        (key % 3 == 0).alias("overtime"),
        F.col("c_nationkey").alias("nation"),
        (key % 25 < 4).cast("int").alias("attrition"),
    )


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph payload per order, with defects by key rule."""
    return payloads_from_orders(driver_table(spark, sf_dir, "orders"))


def payloads_from_orders(orders: DataFrame) -> DataFrame:
    """JSON node/edge graphs built row by row from the order columns.

    ``m = o_orderkey % 20`` picks the defect of a payload, so that each repair
    action occurs in a fixed share of the table.
    """
    key = F.col("o_orderkey")
    okey = key.cast("string")
    m = key % 20

    order_node = F.concat(
        F.lit('{"id":"o'), okey, F.lit('","label":"order '), okey, F.lit('"'),
        F.when(m == 1, F.lit(',"type":""')).otherwise(F.lit(',"type":"order"')),
        F.when(m == 2, F.lit(',"description":7')).otherwise(F.lit("")),
        F.when(m == 3, F.lit(',"color":"red"')).otherwise(F.lit("")),
        F.lit(',"properties":{"total":'), F.col("o_totalprice").cast("string"),
        F.lit(',"priority":"'), F.col("o_orderpriority"), F.lit('"'),
        F.when(m == 4, F.lit(',"__proto__":1,"nested":{"a":1},"tags":["a",{"b":1},true,null,2.5,"z"]'))
        .when(m == 5, F.lit(',"note":"two\\twords","long":"abcdefghijklmnopqrstuvwxyz0123456789"'))
        .when(m == 6, F.lit(',"p1":1,"p2":2,"a3":3,"a4":4')).otherwise(F.lit("")),
        F.lit("}}"))
    customer_label = (
        F.when(m == 7, F.concat(F.lit("customer\\u0001  no "), F.col("o_custkey").cast("string")))
        .when(m == 8, F.lit("a customer whose label is far too long to keep"))
        .when(m == 9, F.lit("  "))
        .otherwise(F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))))
    customer_node = F.concat(F.lit('{"id":"c'), F.col("o_custkey").cast("string"),
                             F.lit('","label":"'), customer_label, F.lit('"}'))
    status_node = F.concat(F.lit('{"id":"s'), F.col("o_orderstatus"), F.lit('","label":"status"'),
                           F.when(m == 10, F.lit(',"properties":[1]')).otherwise(F.lit("")), F.lit("}"))
    extra_nodes = (F.when(m == 11, F.lit(',{"id":" ","label":"x"},5'))
                   .when(m == 12, F.lit(',{"id":"x1","label":"x"},{"id":"x2","label":"x"},{"id":"x3","label":"x"}'))
                   .otherwise(F.lit("")))
    edge = F.concat(F.lit('{"source":"c'), F.col("o_custkey").cast("string"),
                    F.lit('","target":"o'), okey, F.lit('","label":"placed","weight":'),
                    F.when(m == 13, F.lit("-1")).when(m == 14, F.lit("true"))
                    .otherwise((key % 10).cast("string")), F.lit("}"))
    second = F.concat(F.lit('{"source":"o'), okey, F.lit('","target":"s'),
                      F.col("o_orderstatus"), F.lit('"}'))
    extra_edges = (F.when(m == 15, F.concat(F.lit(","), edge))
                   .when(m == 16, F.concat(F.lit(',{"source":"o'), okey, F.lit('","target":"gone"},"edge"')))
                   .when(m == 12, F.concat(F.lit(","), second, F.lit(","), second, F.lit(","), second))
                   .otherwise(F.lit("")))
    metadata = F.when(m == 17, F.lit("[]")).otherwise(
        F.concat(F.lit('{"title":"order '), okey, F.lit('"}')))
    graph = F.concat(F.lit('{"nodes":['), order_node, F.lit(","), customer_node, F.lit(","),
                     status_node, extra_nodes, F.lit('],"edges":['), edge, F.lit(","), second,
                     extra_edges, F.lit('],"metadata":'), metadata, F.lit("}"))
    payload = (F.when(m == 18, F.when(key % 40 == 18, F.lit(None)).otherwise(F.lit('{"nodes":NaN}')))
               .when(m == 19, F.when(key % 60 == 19, F.lit('{"nodes":{},"edges":null,"extra":1}'))
                     .when(key % 60 == 39, F.lit("[1,2]"))
                     .otherwise(F.concat(F.lit('{"nodes":[],"edges":[],"metadata":{"pad":"'),
                                         F.repeat(F.lit("x"), 1500), F.lit('"}}'))))
               .otherwise(graph))
    return orders.select(
        F.concat(F.lit("inv"), okey).alias("payload_id"),
        F.concat(F.lit("agent"), (key % 3).cast("string")).alias("source_agent_id"),
        F.when(key % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("msg"), okey)).alias("anchor_message_id"),
        F.when(key % 5 == 0, None).otherwise(F.concat(F.lit("run"), (key % 100).cast("string"))).alias("run_id"),
        payload.alias("payload_json"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a few numeric and categorical features."""
    d = driver_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = driver_table(spark, sf_dir, "labels")
    return labels.join(d, "doc_id").select(
        "doc_id", "lang", "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.log1p("n_chars").alias("log_chars"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("int").alias("target"),
    )
