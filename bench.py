"""Wall-clock of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_QUERIES`` (comma-separated
names, ``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from pathclear.queries import catalogue

HEADLINE = [
    "q_label_join", "q_confusion", "q_alarm_events", "q_rollup_splits", "q_run_summary", "q_asof_nearest",
    "q_object_checks", "q_event_join", "q_fp_catalogue", "q_theil_sen", "q_tf_asof", "q_hits_window",
    "q_preprocess_counts", "q_lowest_cell", "q_floor_support", "q_plane_lsq", "q_range_image",
    "q_section_median", "q_lateral_profile", "q_point_labels", "q_depth_pixels", "q_history_clearance",
    "q_components", "q_component_features", "q_rejection_chain", "q_profile_shift", "q_gap_clusters",
    "q_track_decision", "q_detect",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalogue.QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true")
        # Methods over the JIT limit run interpreted; smaller pieces are faster then.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the Python workers before the clock.
    catalogue.QUERIES["q_first_hit"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        begin = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
