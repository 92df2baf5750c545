"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once to warm up and twice for time; the faster run counts. All
rows are computed, and written nowhere.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.registry import QUERIES

HEADLINE = (
    "incident_timeline",
    "build_incident_json",
    "extract_header_fields",
    "activity_rows",
    "pivot_times",
    "parse_response",
    "validate_record",
    "upsert_incidents",
    "ingest_pipeline",
    "message_parts",
    "take_until_stop",
    "poll_round",
    "poll_stats",
    "anti_join_processed",
    "dedupe_filenames",
    "stream_dedup_messages",
    "assemble_pages",
    "location_segments",
    "incident_summary",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(min(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
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
