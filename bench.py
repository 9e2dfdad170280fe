"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print ONE JSON line.

Each query is fully executed (written to a no-op sink via ``count`` of its
result); times are wall-clock seconds after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridstone.plans.catalog import load_all  # noqa: E402
from gridstone.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app="gridstone-bench")
    specs = load_all()
    names = only or [n for n, s in specs.items() if s.headline]
    # warm-up: JVM, parquet footers
    specs["model_budget_stats"].build(spark, sf_dir).count()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = specs[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
