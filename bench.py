"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder with the tables, BENCH_CPUS the number of local
threads, BENCH_RUNS the timed runs per query after one warm-up (median taken).
Each run stages its tables in a folder of its own, which is removed after it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from riskbook.plans.queries import all_queries  # noqa: E402
from riskbook.sources import run_folder  # noqa: E402

HEADLINE = [
    "prepared_loans",  # prepare
    "column_summary", "null_profile", "distinct_counts", "class_means",  # profile
    "default_rate_by_grade", "segment_report",  # segment report
    "corr_matrix", "information_value",  # screening
    "stratified_split", "pd_coefficients", "lgd_residual_trend",  # training
    "expected_loss_fitted", "portfolio_loss_fitted",  # scoring
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskbook-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="riskbook-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def timed(name: str) -> float:
        with run_folder(spark):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

    seconds, jobs = {}, {}
    for name in HEADLINE:
        spark.sparkContext.setJobGroup(name, name)
        timed(name)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "jobs": jobs,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
