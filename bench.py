"""Times every registered query and prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores (default: all)
BENCH_RUNS     timed runs per query after one untimed run; the median counts (default 3)
BENCH_QUERIES  names, comma-separated (default: all)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from fleetops.plans.queries import QUERIES
from fleetops.plans.session import local_session


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or os.cpu_count()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else list(QUERIES)

    spark = local_session("bench", cores)
    seconds = {}
    for name in chosen:
        query = QUERIES[name]
        timed(query, spark, folder)
        seconds[name] = round(statistics.median(timed(query, spark, folder) for _ in range(runs)), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
