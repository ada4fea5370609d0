"""Benchmark the headline selection queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default: the headline set).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from infosieve.plans.queries import QUERIES  # noqa: E402
from infosieve.session import build_session, drop_scratch  # noqa: E402

HEADLINE = ["mrmr_lineitem", "max_relevance_lineitem", "mrmr_sparse", "mrmr_instance", "mrmr_feature",
            "zero_recovery", "custom_score_table", "custom_score_vector", "custom_score_joint", "batch_policy",
            "csv_scan", "feature_csv_scan", "mrmr_lazy", "mrmr_bitmaps", "mrmr_stored", "rank_correlations"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = build_session(f"local[{cpus}]", app_name="infosieve-bench", shuffle_partitions=2 * cpus,
                          extra={"spark.driver.memory": "16g"})
    # warm the JVM once (class loading, JIT, codegen caches): the same queries on the
    # smallest scale factor, untimed
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm):
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times, rows = {}, {}
    for name in names:
        t = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        # run the whole plan on the executors without shipping rows to Python
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        rows[name] = df.count()
        drop_scratch(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": cpus, "warmup": warm}))
    spark.stop()


if __name__ == "__main__":
    main()
