"""Time the headline queries on local Spark; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quern.plans import catalog

HEADLINE = (
    "agg_full_scan", "agg_from_metadata", "agg_from_stats", "agg_allow_sparse", "agg_allow_medium", "agg_allow_dense", "agg_allow_single_block",
    "agg_allow_range", "agg_deny", "agg_allow_deny", "gen_three", "agg_duplicates", "encoding_sizes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles
            began = time.time()
            queries[name](spark, sf_dir).collect()
            runs.append(time.time() - began)
        times[name] = round(min(runs[1:]), 4)
    print(json.dumps({"metric": "total of the headline queries, best of two warm runs", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
