"""Time the headline queries; prints one JSON line.

Reads $BENCH_SF_DIR on local[$BENCH_CPUS]. Each query is written to Spark's
no-op sink, so every row and column is computed. Jobs a query runs while it is
being built count as well.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from registry.queries import queries  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "experiment_labels", "winback_target", "validity_interval_join", "backward_nearest",
    "next_subscription", "winback_responders_treatment", "take_rate_treatment",
    "take_rate_control_curve", "campaign_funnel", "daily_features_week1", "median_week1",
    "training_frame", "scoring_frame", "quantile_bins", "kernel_density", "box_summary",
    "tracking_by_bin", "payload_batches", "curve_areas", "calibration_table", "uplift_scores",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = queries()
    chosen = sys.argv[1:] or HEADLINES

    def run(name: str) -> float:
        start = time.perf_counter()
        all_queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("experiment_labels")   # start-up is not part of any query
    times = {name: round(run(name), 3) for name in chosen}
    scale = Path(FOLDER).name.removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
