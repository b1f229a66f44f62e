"""Times the engine's headline queries; prints one JSON line.

Every query runs once to warm up and once timed, to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from framewright.plans.queries import QUERIES

HEADLINE = [
    "fold_distribution", "sliding_windows", "window_step7", "window_multiplicity", "flatten_windows", "padding_rate", "feature_min_max",
    "standardize_params", "standardize_rows", "split_assign", "confusion_matrix", "class_prf", "cv_summary", "benchmark_table", "parse_paths", "ear", "mar",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
