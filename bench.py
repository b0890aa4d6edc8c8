"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
input and the local cores. Every query is computed in full (noop sink); the
session cache stays empty, so queries share no results.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from crosswise.plans import catalog

HEADLINE = (
    "p05_grouped_winsorize",
    "flagship_panel",
    "f10_eligibility",
    "q02_quintiles",
    "o01_forward_returns",
    "b01_quintile_performance",
    "b05_cost_scenarios",
    "b09_long_only_weekly",
    "b10_portfolio_metrics",
    "e05_weekly_evaluation",
    "e08_comparative_summary",
    "w01_rolling_window",
    "w07_rolling_least_squares",
    "g03_protection_gate",
    "m03_parse_and_validate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("crosswise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="crosswise-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Megabyte-sized local shuffles: keep one partition per core.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # Plans here generate more classes than the default code cache keeps.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's scan, shuffle and Python paths on the smallest tables.
    tiny = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("flagship_panel", "b01_quintile_performance"):
        catalog.QUERIES[name](spark, tiny if os.path.isdir(tiny) else sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
