"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is fully executed with the ``noop`` sink (no driver collect);
the reported time per query is the best of ``$BENCH_REPEAT`` runs (default 2),
after an untimed warm-up on the smallest tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retentia.plans.registry import load_all  # noqa: E402
from retentia.session import build_session  # noqa: E402

HEADLINE = [
    "kpi_all", "kpi_revenue_decomposition", "kpi_target_validation", "std_enforce_schema", "missing_handle",
    "dedup_most_complete", "dedup_removed_audit", "profile_numeric", "profile_categorical", "segment_ranked",
    "strategy_summary", "dist_percentiles", "dist_density", "ts_chart_series", "ts_trend", "corr_spearman",
    "chart_quarterly_composition", "chart_marketing_outlier", "scan_csv",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), app_name="retentia-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = load_all()
    # Warm-up (not timed): each headline query once on the smallest tables, so
    # JIT, codegen caches and Python workers are warm as on a long-lived cluster.
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm) and os.environ.get("BENCH_WARMUP", "1") == "1":
        for name in names:
            reg[name][0](spark, warm).write.format("noop").mode("overwrite").save()
    timings = {}
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    for name in names:
        fn, _ = reg[name]
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
