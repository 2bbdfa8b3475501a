"""What one heavy key costs: split plans against their plain forms.

Repeats the given orders and events BENCH_COPIES times with fresh keys and moves a third of
the rows to a single customer or user. Prints one JSON line: per query the wall seconds and
the seconds of its longest task. With many executors the longest task is what is left of the
wall time, whatever their number.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from bench import CATALOGUE, compute, plain
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

NAMES = ["w1_ranking", "w4_running", "w7_share", "j13_as_of", "a18_session_window", "f6_correlated_scalar_subquery"]


def skewed_tables(spark: SparkSession, table_dir: str, copies: int, out: str) -> None:
    def third_to_one(key: str):
        return F.when(F.pmod(F.xxhash64("row"), F.lit(3)) == 0, 0).otherwise(F.col(key) * copies + F.col("copy"))

    for table, row, key in (("orders", "o_orderkey", "o_custkey"), ("events", "event_id", "user_id")):
        rows = spark.read.parquet(f"{table_dir}/{table}.parquet")
        repeated = (
            rows.repartition(64)
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .withColumn("row", F.col(row) * copies + F.col("copy"))
            .withColumn(key, third_to_one(key))
            .withColumn(row, F.col("row"))
        )
        if table == "events":
            repeated = repeated.withColumn("ts", F.expr("ts + make_dt_interval(0, 0, 0, copy * 0.731)"))
        repeated.select(rows.columns).write.parquet(f"{out}/{table}.parquet")


def longest_tasks(log_dir: str) -> dict[str, float]:
    """Seconds of the longest task per job group, from Spark's event log."""
    groups: dict[int, str] = {}
    longest: dict[str, float] = {}
    for log in sorted(path for path in Path(log_dir).rglob("*") if path.is_file()):
        for line in log.open(encoding="utf-8"):
            if not line.startswith('{"Event":"SparkListener'):
                continue
            event = json.loads(line)
            if event["Event"] == "SparkListenerJobStart":
                group = event.get("Properties", {}).get("spark.jobGroup.id")
                groups.update(dict.fromkeys(event["Stage IDs"], group) if group else {})
            elif event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in groups:
                info = event["Task Info"]
                seconds = (info["Finish Time"] - info["Launch Time"]) / 1000
                group = groups[event["Stage ID"]]
                longest[group] = max(longest.get(group, 0.0), seconds)
    return longest


def measured(spark: SparkSession, label: str, query, table_dir: str) -> float:
    compute(query(spark, table_dir))
    spark.sparkContext.setJobGroup(label, label)
    start = time.perf_counter()
    compute(query(spark, table_dir))
    seconds = round(time.perf_counter() - start, 3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return seconds


def main() -> None:
    table_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "100"))
    scratch = tempfile.mkdtemp(prefix="planloom-skew-")
    log_dir = tempfile.mkdtemp(prefix="events-", dir=scratch)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("planloom-bench-skew")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{log_dir}")
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.rolling.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        skewed_tables(spark, table_dir, copies, scratch)
        wall = {
            label: measured(spark, label, query, scratch)
            for name in NAMES
            for label, query in ((name, CATALOGUE[name]), (f"{name} plain", plain(name)))
        }
    finally:
        spark.stop()
    longest = longest_tasks(log_dir)
    print(json.dumps({"metric": "a third of the rows on one key", "unit": "sec", "copies": copies,
                      "queries": {label: {"wall": wall[label], "longest_task": longest.get(label)} for label in wall}}))


if __name__ == "__main__":
    main()
