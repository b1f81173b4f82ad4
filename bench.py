"""Times the headline queries once warm and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from sievelog.plans.catalog import QUERIES
from sievelog.session import build_session

HEADLINE = (
    "parse_logs",
    "level_by_source_hour",
    "basic_features",
    "char_ratios",
    "char_entropy",
    "word_entropy",
    "pattern_counts",
    "security_keywords",
    "time_delta_window",
    "jaccard_window",
    "all_features",
    "tfidf_vocabulary",
    "tfidf_weights",
    "rare_words",
    "embedding_stats",
    "detect_batch",
    "stratified_split",
    "roc_auc",
    "average_precision",
    "create_alerts",
    "cooldown",
    "alert_payload",
    "hourly_profile",
    "bruteforce_burst",
    "injection_session",
    "sliding_window_60_10",
    "stream_parse",
    "stream_cooldown",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # tables of a large store come as many files; the given ones are a single row group each, which no scan can split
    many = tempfile.mkdtemp(prefix="bench-tables-")
    for table in sorted(os.listdir(sf_dir)):
        spark.read.parquet(f"{sf_dir}/{table}").repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{many}/{table}")
    seconds = {}
    for name in names:
        runs = []
        # the first run warms the code paths and is not counted when there are more
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, many).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
        print(f"{name} {[round(r, 2) for r in runs]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
