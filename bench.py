"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_pricing_summary", "agg_group_by", "agg_distinct", "agg_rollup", "agg_percentile_cont", "join_multiway", "join_left", "join_anti_null_keys", "subquery_correlated",
    "window_ranking", "window_running_rows", "topn_offset", "setop_intersect_all", "distinct_on", "web_wide_sums", "web_top_groups", "web_high_cardinality", "web_regex_key", "text_match", "stats_profile",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from larkspur.plans import catalog

    found, times = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for turn in range(4):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if turn:
                runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
