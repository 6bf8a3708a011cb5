"""Times every registered query; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default all), BENCH_REPEAT (default 2: best of N runs,
so one-off scheduling noise of a shared machine does not dominate sub-second stages).
Each query runs to completion into Spark's ``noop`` sink: every row is produced, none is
collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    from flowlure.plans.catalog import QUERIES
    from flowlure.session import local_session

    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = local_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    # Warm-up (JVM, codegen caches, Python workers); not timed.
    QUERIES["daily_attackers"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["strategy_sweep"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        best = None
        for _ in range(repeat):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
