"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` (default 8),
``BENCH_RUNS`` (default 2; the best run counts) and ``BENCH_QUERIES`` (names, or
``all``). Every result row is computed and thrown away (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from spanworks.queries import all_queries

HEADLINE = (
    "start_stop_dataset start_stop start_stop_direct weekly_episodes weekly_unique "
    "survival_summary team_weekly span_of_control forward_fill asof_join covariate_at interval_join "
    "interval_join_orders dedup_latest dedup_left_join calc_join clean_strings transform_chain "
    "duplicate_keys nullity_stats quality_profile rule_checks key_candidates table_row_counts "
    "audit_tables report_main snapshot_parquet_roundtrip snapshot_log"
).split()


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if wanted == "all" else wanted.split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanworks-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="spanworks-bench-"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, directory).write.format("noop").mode("overwrite").save()
            took.append(round(time.perf_counter() - start, 3))
        seconds[name], first[name] = min(took), took[0]
        print(f"{name} {min(took):.2f}", file=sys.stderr, flush=True)
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "first_run": first, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
        "cpus": int(cpus),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
