"""Headline timings: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion through Spark's ``noop`` sink (every row is
computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flagtide import registry  # noqa: E402
from flagtide.session import get_session  # noqa: E402

HEADLINE = [
    "extract_guards",       # parse every file, cut snippets
    "group_candidates",     # + strict gate, limit check, grouping
    "top_flags",            # flagship
    "first_violation",      # plan parse + all validation joins
    "benchmark_grounding",  # keyless containment join
    "rewrite_guards",       # rewrite job over every file
    "delivery_status",      # outcomes + outbox
    "remediation_run",      # plan attempts to reports, the whole chain
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="flagtide-bench", shuffle_partitions=2 * cpus,
                        **{"spark.driver.memory": "16g"})
    registry.load_all()
    times = {}
    from flagtide.catalog.extract import reset_memo

    # warm-up (JIT, Python workers) on the smallest fixture; not timed
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        registry.QUERIES["top_flags"](spark, warm).write.format("noop").mode("overwrite").save()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    for name in names:
        reset_memo()
        t0 = time.perf_counter()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    n_files = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    total = round(sum(times.values()), 3)
    out = {
        "metric": "headline_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "files": n_files,
    }
    if "extract_guards" in times:
        out["extract_files_per_sec"] = round(n_files / times["extract_guards"], 1)
    if "rewrite_guards" in times:
        out["rewrite_files_per_sec"] = round(n_files / times["rewrite_guards"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
