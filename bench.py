"""Headline queries on local[BENCH_CPUS]; prints one JSON line.

``queries`` holds seconds at BENCH_SF_DIR.  ``scaling`` compares them with the next smaller tables: lineitem rows per
second at both sizes, and how much longer the larger size takes for how many more rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "w02_burst_groups", "f05_protocol_block", "f09_compact_features", "a02_collisions", "a10_describe_duration", "a13_ks_statistic", "j02_fold_lookup",
    "a15_macro_f1", "a18_calibration_summary", "m04_length_chains", "j04_iou_join", "j05_greedy_match", "a25_threshold_sweep", "w11_fused_boxes",
    "a31_accuracy_report", "a33_ledger_totals", "w09_chunks", "r01_bm25", "a43_hit_rates", "j09_class_distances",
]


def timed(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    seconds = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEM", "12g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    small_dir = os.environ.get("BENCH_SMALL_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.01"))
    rows = lambda d: spark.read.parquet(f"{d}/lineitem.parquet").count()
    small = timed(spark, small_dir) if os.path.isdir(small_dir) and small_dir != sf_dir else {}  # also warms up code and session
    seconds = timed(spark, sf_dir)
    n = rows(sf_dir)
    scaling = {}
    if small:
        m = rows(small_dir)
        scaling = {q: {"rows_per_sec": round(n / max(s, 1e-3)), "rows_per_sec_small": round(m / max(small[q], 1e-3)), "times_longer": round(s / max(small[q], 1e-3), 2)} for q, s in seconds.items()}
        scaling["times_more_rows"] = round(n / max(m, 1), 2)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir).removeprefix("sf"), "lineitem_rows": n, "cpus": int(cpus), "scaling": scaling}))


if __name__ == "__main__":
    main()
