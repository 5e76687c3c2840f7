"""Times headline queries: prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
HEADLINE = (
    "c_flagship", "c_union", "c_all", "c_not_in", "c_on_score", "c_using_weighted_max", "c_window", "c_identity_map", "c_mcp_weight", "c_group_key",
    "s_agg", "s_join_left", "s_exists", "s_win_row_number", "s_win_moving", "s_win_groups", "s_zscore_ctx", "p_path", "p_contains", "p_between",
)


def main() -> None:
    """Runs each query once to warm up and three times for the median."""
    from pyspark.sql import SparkSession

    from situ.plans.catalog import SQL, engine

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    e, out = engine(spark, folder), {}
    for name in HEADLINE:
        seconds = []
        for i in range(4):
            began = time.time()
            e.execute(SQL[name][0]).df.write.format("noop").mode("overwrite").save()
            if i:
                seconds.append(time.time() - began)
        out[name] = round(statistics.median(seconds), 4)
    print(json.dumps({"metric": "median seconds, sum of headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
