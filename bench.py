"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list),
BENCH_RUNS (default 3 timed runs after one warm-up; the median counts). A query whose first timed
run takes over five seconds is not repeated.
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

from tokenloom.catalog import QUERIES  # noqa: E402
from tokenloom.session import build_session  # noqa: E402

HEADLINE = [
    "token_profile",
    "entities",
    "fact_density",
    "sentence_intent",
    "language_confusion",
    "domain_counts",
    "compress_basic",
    "compress_standard",
    "sensitive_scan",
    "bm25",
    "sentence_filter",
    "entity_register",
    "phrase_table",
    "delta_prune",
    "budget_prune",
    "summary",
    "optimize",
    "tool_cache",
    "savings",
    "dashboard",
    "free_limit",
    "chat_limit",
    "tier_stats",
    "tools_dsl",
    "seen_tools",
]


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)
        times = [run(spark, name, folder)]
        while len(times) < runs and times[0] < 5:
            times.append(run(spark, name, folder))
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
