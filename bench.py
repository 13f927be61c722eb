"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads), BENCH_RUNS (timed passes after one for warming up; the median counts).
Every run computes the whole result and throws it away; nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.spark_queries import QUERIES  # noqa: E402

HEADLINE = [
    "overview_exact",
    "overview_tolerant",
    "column_stats_tolerant",
    "composite_key_overview",
    "composite_key_column_stats",
    "duplicate_pairs_flat",
    "low_cardinality_key_stats",
    "expression_key_overview",
    "null_key_summary",
    "only_in_a",
    "duplicate_keys",
    "rows_diffs",
    "diff_rows_page",
    "diff_join_flat",
    "cell_changes",
    "char_diff",
    "document_text_stats",
    "array_column_diff",
    "csv_roundtrip_diff",
    "parquet_export_diff",
    "typed_load",
    "history_retained",
    "insert_new_by_name",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("twinframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, list[float]] = {name: [] for name in names}
    # All queries run once before any is timed, so that the order does not decide who pays for warming up the JVM.
    for _ in range(runs + 1):
        for name in names:
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - started)
    seconds = {name: round(statistics.median(taken[1:]), 3) for name, taken in times.items()}
    spark.stop()
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
