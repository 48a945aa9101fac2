"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and ``$BENCH_RUNS`` (3) times more; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from stringwright.catalog.checks import QUERIES
from stringwright.session import local_session

HEADLINE = [
    "value_freq",
    "infer_types",
    "missing_patterns",
    "typo_repair",
    "similar_pairs",
    "common_affix",
    "num_rank",
    "proc_month_dmy",
    "target_encode",
    "minhash_encode",
    "col_features",
    "clean_only",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    for name in names:
        times, rows = [], 0
        for _ in range(runs + 1):
            started = time.time()
            rows = QUERIES[name](spark, sf_dir).count() if not times else rows
            if times:
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        rates[name] = round(rows / seconds[name]) if seconds[name] else None
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "result_rows_per_sec": rates,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
