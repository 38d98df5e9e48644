"""Run the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loanspan.plans.registry import QUERIES  # noqa: E402
from loanspan.plans.study import study  # noqa: E402

HEADLINE = [
    "text_scan_performance",
    "typed_text_performance",
    "origination_standardized",
    "performance_standardized",
    "final_validation",
    "event_candidates",
    "event_map",
    "loan_age_panel",
    "model_dataset",
    "time_varying_intervals",
    "interval_check",
    "kaplan_meier",
    "aalen_johansen",
    "vintage_cif",
    "vintage_horizons",
    "grouped_pd",
    "nested_sample",
    "profile_scores",
    "cox_baseline",
    "cox_cause_specific",
    "tv_predictor_support",
    "tv_binary_support",
    "cox_time_varying",
    "fine_gray_default",
    "ph_tests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    tables = study(spark, sf_dir)
    # The materialized study tables are part of the work; each is timed when it is first built.
    for name in ["raw_orig", "raw_perf", "events", "model", "intervals"]:
        timed(f"table_{name}", lambda name=name: getattr(tables, name).count())
    for name in HEADLINE:
        timed(
            name,
            lambda name=name: QUERIES[name](spark, sf_dir)
            .write.format("noop")
            .mode("overwrite")
            .save(),
        )
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "loan_months": tables.raw_perf.count(),
                "intervals": tables.intervals.count(),
            }
        )
    )
    tables.drop()


if __name__ == "__main__":
    main()
