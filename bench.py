"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quernel.plans import suite

NAMES = ["pricing_summary", "filter_range", "apply_arith", "flatmap_split", "join_inner", "join_multi_key", "counting_join", "multiway_triangle", "agg_group", "agg_multi_key", "uda_sum_squares", "difference", "order_limit", "counter_ordered", "stateful_scan", "sigma_clip", "tc_reach", "sssp"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(2 if name in ("tc_reach", "sssp") else 4):
            t = time.time()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total seconds, median of warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()
