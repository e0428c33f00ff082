"""Run queries against DuckDB and print one line each:
python tests/check.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mileglass.session import build_session  # noqa: E402
from mileglass.plans.registry import all_oracles, all_queries  # noqa: E402
from tests import oracle  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    queries, sqls = all_queries(), all_oracles()
    for name in wanted or queries:
        start = time.time()
        try:
            got = oracle.spark_result(queries[name](spark, sf_dir))
            took = time.time() - start
            if name in sqls:
                diff = oracle.difference(got, oracle.duck_result(con, sqls[name]))
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                state = "rows only"
            print(f"{name:28s} {took:6.2f}s {len(got[1]):7d} {state[:600]}", flush=True)
        except Exception as e:
            print(f"{name:28s} ERROR {type(e).__name__} {str(e)[:300]} ... {str(e)[-1500:]}", flush=True)
