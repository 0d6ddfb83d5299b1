"""Wall time of the queries at one scale: prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default all), ``BENCH_RUNS`` (timed runs per query, default 1)
and ``BENCH_QUERIES`` (comma-separated names, by default ``all``). Every row and column is computed: results go
to Spark's ``noop`` sink. One untimed query warms the session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.catalog import all_queries  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    asked = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    partitions = str(os.cpu_count() if cpus == "*" else int(cpus))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": partitions,
            "spark.driver.memory": "12g",
            "spark.ledgerloom.spread": str(2 * int(partitions)),
            # small test data: keep all cores busy after a shuffle instead of merging to one partition
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = {name: run for name, (run, _) in all_queries().items()}
    if not asked:
        asked = ["all"]
    queries = {name: run for name, run in catalogue.items() if asked == ["all"] or name in asked}

    def once(run) -> float:
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once(next(iter(queries.values())))
    seconds = {}
    for name, run in queries.items():
        seconds[name] = round(statistics.median(once(run) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": partitions,
            }
        )
    )


if __name__ == "__main__":
    main()
