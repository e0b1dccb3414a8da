"""Time the library's short forms against the direct ones on stored tables.

Writes the derived tables of $BENCH_SF_DIR to a new temporary folder first, so
that neither form pays for deriving them. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from cohortlift.operators.numbering import number_rows  # noqa: E402
from cohortlift.plans import funnel, labels, takerate  # noqa: E402
from cohortlift.sources.fixtures import Fixtures  # noqa: E402
from registry import long_forms, queries  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLES = ["subscriptions", "campaign_events", "campaigns"]


class Stored:
    """The derived tables, read back from where they were stored."""

    def __init__(self, data: Fixtures, base: str):
        self.spark, self.folder = data.spark, base
        for table in TABLES:
            getattr(data, table).write.parquet(f"{base}/{table}")
            setattr(self, table, data.spark.read.parquet(f"{base}/{table}"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench_forms")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    data = Stored(Fixtures(spark, FOLDER), tempfile.mkdtemp(prefix="run-"))
    nearest = lambda: labels.nearest_after_entry(
        queries._dropout_rollup(data), data.subscriptions, queries.WINDOW, [])
    ids = data.subscriptions.select("hs_user_id", "subscription_id")
    forms = {
        "labels": (lambda: labels.label_groups(nearest(), queries.HORIZON),
                   lambda: long_forms.labels_by_group(nearest(), queries.HORIZON)),
        "control_curve": (lambda: takerate.control_curve(queries._lapsed(data)),
                          lambda: long_forms.control_curve_by_day(queries._lapsed(data))),
        "funnel": (lambda: funnel.campaign_funnel(
                       data.campaign_events, data.campaigns, data.subscriptions, heavy=[]),
                   lambda: long_forms.funnel_by_fan_out(
                       data.campaign_events, data.campaigns, data.subscriptions)),
        "row_numbers": (lambda: number_rows(ids, "hs_user_id", "subscription_id")[0],
                        lambda: long_forms.number_in_one_partition(
                            ids, "hs_user_id", "subscription_id")),
    }

    def seconds(build) -> float:
        best = float("inf")
        for _ in range(4):   # the first run warms up
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return round(best, 3)

    print(json.dumps({name: {"short": seconds(short), "direct": seconds(direct)}
                      for name, (short, direct) in forms.items()}))
    spark.stop()


if __name__ == "__main__":
    main()
