"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's seconds also go to stderr as it ends, and a run that is stopped early prints the line of what it has.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

from pyspark.sql import SparkSession

# Whole queries from every part of the inventory; each is written to a sink that keeps nothing.
HEADLINE = (
    "passenger_feature_set",
    "house_feature_set",
    "house_feature_set_advanced",
    "src_csv",
    "union_train_test",
    "group_size_suppliers",
    "grouped_median",
    "grouped_median_prices",
    "median_imputer",
    "group_rule_stats",
    "auc_roc",
    "auc_roc_sliced",
    "weight_sweep",
    "fold_mean",
    "join_group_stats",
    "join_group_stats_large",
    "hierarchical_impute",
    "order_diagnostics",
    "string_index",
    "scale_centered",
    "hash_fold",
    "soft_vote",
    "boost_split",
    "rule_override",
    "variant_set",
    "variant_diagnostics",
    "model_disagreement",
    "pipe_linear",
    "pipe_tree",
    "lr_reg",
    "boost_reg",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tabloom import catalog

    registered = catalog.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}

    def report() -> None:
        line = {
            "metric": "total_headline_seconds",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(sf_dir.rstrip("/")),
        }
        print(json.dumps(line), flush=True)

    def stopped(*_) -> None:
        report()
        os._exit(124)

    signal.signal(signal.SIGTERM, stopped)
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    report()


if __name__ == "__main__":
    main()
