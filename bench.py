"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the tables (default sf0.1), BENCH_CPUS the cores. Each query
runs to a no-op sink, so the whole result is computed and none of it is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sensorframe import local_session  # noqa: E402
from sensorframe.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "w2_task_segments a1_clock_summary a3_segment_summary j7_interval_ranges j8_nearest_asof j9_two_stream_intersect w10_resample_grid "
    "w5_sliding_windows a25_window_features a7_mask_window_stats p19_quality_tier a8_window_drop_summary j3_or_key_join j6_nearest_session "
    "m3_fold_table a10_confusion_metrics a11_roc_auc a12_average_precision a13_fold_aggregates j13_strategy_delta t6_threshold_fixed "
    "t7_threshold_adaptive m13_per_fold_evaluation a15_dimension_stats a17_subject_standardiser t3_top_k_frames x8_edge_energy "
    "w7_carry_forward w9_lag_abs_difference j10_positional_pairs x5_baseline_modes m5_balanced_resample m9_platt_calibration v1_task_validation "
    "m8_search_then_evaluate s11_partitioned_sink e2e_aligned_task_frames e2e_strategy_report e2e_selected_frames"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    wanted = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    rate: dict[str, int] = {}
    # A scan, a join, a window and a Python worker, so that no query pays for their first use.
    for name in ("w3_lag_difference", "j8_nearest_asof", "x8_edge_energy"):
        if name in QUERIES:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    samples = spark.read.parquet(f"{folder}/events.parquet").count()
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        rate[name] = round(samples / took[name])
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "event_rows_per_second": rate,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
