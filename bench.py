"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ["tiered_scoring", "scd_upsert", "provider_rollup", "best_match_window", "fuzzy_match", "multi_filter_page", "json_extract", "page_filter", "financial_merge", "robust_outliers"]


def main() -> None:
    from tallyframe.plans.registry import QUERIES
    from tallyframe.session import build_session

    spark = build_session(f"local[{CPUS}]", "bench", int(CPUS), **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):  # the first one warms up
            began = time.time()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
