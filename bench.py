"""Headline timings: warm median of three, every row computed, nothing collected.

`plain` holds the same results asked for as one ordinary SQL statement over the same
views, the way a plan author would write them without regard to heavy keys.

Settings: BENCH_SF_DIR (table directory), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from planloom.operators import CATALOGUE
from planloom.operators.query import Query

HEADLINE = [
    "a2_pricing_summary",
    "a12_arg_extremes",
    "a18_session_window",
    "j3_right_outer",
    "j9_interval_join",
    "j11_star_join",
    "j12_lateral_top2",
    "j13_as_of",
    "w1_ranking",
    "w4_running",
    "w6_top3",
    "w7_share",
    "f6_correlated_scalar_subquery",
    "u3_intersect",
    "x7_word_count",
    "q1_cte_scalar_subquery",
    "e1_csv_to_csv",
    "e3_partitioned_parquet",
    "e4_two_targets",
]

PLAIN = {
    "a18_session_window": """
        select user_id, session_window.start as session_start, session_window.end as session_end,
               count(*) as events, round(sum(value), 2) as total
        from events group by user_id, session_window(ts, '30 minutes')
    """,
    "j13_as_of": """
        select event_id as purchase_id, user_id, view_id
        from (select event_id, user_id, event_type,
                     last_value(case when event_type = 'view' then event_id end, true) over (
                         partition by user_id order by ts, event_type = 'purchase', event_id
                         rows between unbounded preceding and current row) as view_id
              from events)
        where event_type = 'purchase'
    """,
    **{
        name: CATALOGUE[name].oracle
        for name in (
            "f6_correlated_scalar_subquery", "j9_interval_join", "j11_star_join", "w1_ranking", "w4_running", "w7_share"
        )
    },
}


def plain(name: str) -> Query:
    return Query(f"{name}_plain", CATALOGUE[name].tables, (("result", PLAIN[name]),))


def compute(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(spark: SparkSession, query, table_dir: str, runs: int = 3) -> float:
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        compute(query(spark, table_dir))
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    table_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="planloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("planloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        everything = [CATALOGUE[name] for name in HEADLINE] + [plain(name) for name in PLAIN]
        for query in everything:
            compute(query(spark, table_dir))
        queries = {name: timed(spark, CATALOGUE[name], table_dir) for name in HEADLINE}
        plain_forms = {name: timed(spark, plain(name), table_dir) for name in PLAIN}
    finally:
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total warm median",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "plain": plain_forms,
                "sf": Path(table_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
