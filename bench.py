"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is
built and run in full (its rows go to a discarding sink) ``BENCH_RUNS`` times,
two by default, and its best time counts, so that JVM warm-up does not.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "pricing_summary",
    "forecast_revenue",
    "promo_effect",
    "promo_effect_shuffled",
    "late_shipments",
    "late_shipments_shuffled",
    "fact_dim_lookup",
    "table_check",
    "identity",
    "key_count",
    "binned_sum",
    "generated_identity",
    "generated_key_count",
    "generated_binned_sum",
    "metric_summary",
    "rank_percentiles",
    "tail_counts",
    "log_parse",
    "log_summary",
    "nested_imbalance",
    "per_worker_summary",
    "run_window",
    "progress_rates",
    "progress_skew",
    "point_lookup",
    "point_lookup_shuffled",
    "range_scan",
    "upsert_delete",
    "op_mix",
    "mix_report",
    "delimited_scan",
    "stream_key_count",
    "stream_tumbling",
]


def main() -> None:
    from loadlens.plans.catalog import QUERIES
    from loadlens.session import build_session
    from loadlens.sources.sinks import discard

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = build_session(
        "loadlens-bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            begin = time.perf_counter()
            discard(QUERIES[name](spark, folder))
            taken.append(time.perf_counter() - begin)
        times[name] = round(min(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": f"total of {len(times)} headline queries, best of {runs}",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
