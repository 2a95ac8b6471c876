"""Headline queries, timed: the median of five runs after one to warm up, which also writes the layouts that are read. Prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))  # for Spark's Python workers
CPUS = os.environ.get("BENCH_CPUS", "8")
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

HEADLINE = {
    "q1_global_sum": "A2_aggregate_global",
    "q2_range_sum": "A3_aggregate_range",
    "q3_key_count": "F15_prune_range_count",
    "q4_correlated_count": "F14_prune_correlated",
    "q5_independent_count": "F14_prune_independent",
    "q6_region_count": "A4_region_count",
    "q7_topic_summary": "A7_topic_summary",
    "q8_since": "F9_since",
    "q9_adjudicate": "A12_adjudicate",
    "q10_reliability": "A11_agent_reliability",
    "q11_conflicts": "J6_pairwise_conflicts",
    "q12_trace_summary": "A20_trace_summary",
    "q13_self_time": "T2_slowest",
    "q14_merkle_commit": "O4_merkle_commit",
    "q15_batch_range_sums": "J9_batch_range_sums",
    "q16_scoped_top_k": "T7_scoped_top_k",
    "q17_running_baseline": "W4_running_baseline",
}


def naive_plans(spark, sf: str) -> dict:
    """The same questions asked of the plain table, without any layout."""
    from pyspark.sql import functions as F

    from manyfold.queries import ranges as Q

    e = Q.events(spark, sf)
    four = (F.sum("value"), F.count(F.lit(1)), F.min("value"), F.max("value"))
    inside = F.col("event_id").between(Q.LO, Q.HI)
    count = F.count(F.lit(1))
    return {
        "q1_global_sum": lambda: e.agg(*four),
        "q2_range_sum": lambda: e.where(inside).agg(*four),
        "q3_key_count": lambda: e.where(inside).agg(count),
        "q4_correlated_count": lambda: e.where("trend > 400").agg(count),
        "q5_independent_count": lambda: e.where("value < 20").agg(count),
        "q6_region_count": lambda: e.where("event_type = 'error'").agg(count),
        "q8_since": lambda: e.where("ts >= timestamp_ntz '2024-01-10 00:00:00'").select("event_id", "user_id", "event_type"),
    }


def timed(df) -> tuple[float, dict]:
    """Seconds, and what the scans of the last plan gave."""
    from manyfold.report import collect_with_report

    began = time.time()
    _, report = collect_with_report(df)
    return time.time() - began, {"rows": report.rows, "bytes": report.bytes, "files": report.files}


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from manyfold.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, reads = {}, {}
    for name, query in HEADLINE.items():
        runs = []
        for _ in range(6):
            began = time.time()
            df = QUERIES[query](spark, SF)
            _, read = timed(df)
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
        reads[name] = read
    for name, ask in naive_plans(spark, SF).items():
        runs = []
        for _ in range(6):
            began = time.time()
            _, read = timed(ask())
            runs.append((time.time() - began, read))
        reads[name] |= {"naive_sec": round(statistics.median(t for t, _ in runs[1:]), 3)} | {f"naive_{k}": v for k, v in runs[-1][1].items()}
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "reads": reads, "sf": os.path.basename(SF.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
