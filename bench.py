"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every run mines for itself: tables shared between queries are dropped first.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import registry  # noqa: E402

HEADLINE = [
    "e2e1_flagship_top_fpr",
    "fim1_itemsets_lineitem",
    "fim3_generalized_itemsets",
    "fim3_generalized_itemsets_level_wise",
    "e2e2_hierarchical_exploration",
    "e2e3_outcome_exploration",
    "tre12_grown_tree",
    "tre14_one_tree_over_all_attributes",
    "e2e2_tree_ranges_to_itemsets",
    "prp11_quantile_bins",
    "shp1_local_shapley",
    "sel8_not_redundant",
    "cor4_correction_t_values",
    "e2e5_support_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.checkpoint.dir", os.environ.get("CHECKPOINT_DIR", "/tmp/checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    seconds = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        times = []
        for _ in range(runs + 1):  # the first run warms up
            registry.forget()
            start = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
