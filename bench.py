"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from orefield.session import build_session  # noqa: E402
from orefield.workload import all_entries  # noqa: E402

HEADLINE = [
    "stg_transactions",
    "int_transactions_enriched",
    "int_daily_transactions",
    "mart_customer_analytics",
    "mart_product_analytics",
    "mart_daily_summary",
    "daily_summary_incremental",
    "clean_to_silver",
    "gold_user_summary",
    "custom_query_join",
    "int_customer_orders",
    "dim_customers",
    "mart_daily_sales",
    "mart_regional_sales",
    "scd2_snapshot",
    "src_csv_ingest",
    "incremental_extract",
    "dataset_fingerprint",
    "watermark_upsert",
    "dq_suite_raw",
    "dq_unique",
    "dq_referential_integrity",
    "dq_daily_metrics",
    "freshness_status",
    "sla_check",
    "health_report",
    "alert_dedup",
    "active_ownership",
    "lineage_closure",
    "bi_category_share",
    "bi_lifetime_hist",
    "stream_mart_upsert",
]


def run(entry, spark, sf_dir) -> float:
    start = time.perf_counter()
    entry(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
        **{"spark.driver.memory": "16g", "spark.log.level": "ERROR", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="orefield-bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries, taken = all_entries(), {}
    for key in HEADLINE:
        run(entries[key], spark, sf_dir)
        taken[key] = round(statistics.median(run(entries[key], spark, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
