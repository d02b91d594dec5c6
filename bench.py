"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and
cores. Each job runs once to warm up, then BENCH_RUNS (default 3) times; the median
counts. Results are written out in full to Spark's no-op sink, not collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import logs
from checks.answering import users
from checks.training import ORDER_PARAMS, PARAMS
from likewise import Indicator
from likewise.functions.times import instant
from likewise.operators import rankings as rk
from likewise.operators.similarity import correlators
from likewise.plans.recommend import recommend
from likewise.plans.train import train


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def write_out(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    orders, usage = logs.order_log(spark, sf_dir), logs.usage_log(spark, sf_dir)
    full = logs.full_log(spark, sf_dir)
    start, end = instant("2024-01-01"), instant(logs.NOW)
    order_model = train(orders, ORDER_PARAMS, "2005-01-01")
    usage_model = train(full, PARAMS, logs.NOW)
    customers = orders.selectExpr("entity_id AS user").distinct().selectExpr("user AS query_id", "user")

    def of(log: DataFrame, names: list[str]) -> DataFrame:
        return correlators(logs.interactions(log), [Indicator(n) for n in names])

    jobs: dict[str, Callable[[], DataFrame]] = {
        "correlators_orders": lambda: of(orders, logs.FLAGS),
        "correlators_events": lambda: of(usage, logs.USAGE),
        "rank_popular": lambda: rk.rank_popular(usage, logs.USAGE, start, end),
        "rank_trending": lambda: rk.rank_trending(usage, logs.USAGE, start, end),
        "rank_hot": lambda: rk.rank_hot(usage, logs.USAGE, start, end),
        "train_events": lambda: train(full, PARAMS, logs.NOW).postings,
        "recommend_events": lambda: recommend(
            users(spark, sf_dir), usage_model, full, PARAMS, logs.NOW
        ),
        "recommend_orders": lambda: recommend(
            customers, order_model, orders, ORDER_PARAMS, logs.NOW
        ),
    }
    seconds = {}
    for name, job in jobs.items():
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            write_out(job())
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
