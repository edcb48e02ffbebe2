"""Times every query of the track engine: python bench.py prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and cores. Every query runs once
to warm up and is then timed RUNS times, of which the median counts; once
BENCH_BUDGET_S seconds have passed, the remaining queries are timed once. The
headline queries come first and alone make up the total.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from wayfold.plans.queries import QUERIES

RUNS = 3
HEADLINE = ("subject_last_index", "time_offset", "clean_stateless", "teleport_filter", "improved_activity", "grid_cells", "s2_cells", "admin_index_boxes", "moves_stats", "stays_stats", "mode_tracker_window", "full_pipeline")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    budget, seconds, runs = float(os.environ.get("BENCH_BUDGET_S", "150")), {}, {}
    start = time.perf_counter()
    for name in (*HEADLINE, *sorted(set(QUERIES) - set(HEADLINE))):
        times, runs[name] = [], RUNS if time.perf_counter() - start < budget else 1
        for _ in range(runs[name] + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds[n] for n in HEADLINE), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
                "pipeline_rows_per_s": round(rows / seconds["full_pipeline"]), "rows": rows, "cpus": int(cpus), "runs": runs, "spark": spark.version, "state": "warm",
            }
        )
    )


if __name__ == "__main__":
    main()
