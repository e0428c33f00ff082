"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then timed while its full result is
computed into a sink that discards rows.  Streaming and model queries do their
work while the query is built, so building is part of the time.
"""

from __future__ import annotations

import json
import os
import time

from mileglass.plans.registry import all_queries
from mileglass.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "gold_hourly", "quality_metrics", "hourly_summary", "top_zips", "hour_of_day_trips", "source_coverage",
    "calendar_slice", "previous_hour_slice", "shift_to_month", "sample_rows", "expect_set", "expectation_report",
    "layer_sink", "gold_stream", "stream_landing_to_silver", "exactly_once_files",
    "graph_repair_counts", "graph_artifacts", "graph_quarantine", "clean_text",
    "profile_table", "impute_group_median", "winsorize", "robust_scale", "skewness", "corr_matrix", "spearman",
    "stratified_split", "class_weights", "evaluate_auc", "last_user_message",
]


def run(query, spark) -> float:
    start = time.time()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times = {}
    for name in HEADLINE:
        run(queries[name], spark)
        times[name] = round(run(queries[name], spark), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
