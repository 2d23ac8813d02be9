"""Time the headline queries and print one JSON line.

Every query reads the listing snapshot; building it (the join of orders and line items) is timed as
its own entry. Each query runs to completion into Spark's no-op sink, so all of its rows are
computed and none pass through the driver.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from marketspark.plans.catalog import QUERIES
from marketspark.plans.market import Market

HEADLINE = [
    "win_running_inventory",
    "win_running_inventory_bind",
    "join_trailing_365d",
    "win_inventory_time",
    "dash_inventory_time",
    "agg_median_price",
    "agg_listed_by_year",
    "agg_turnover_area",
    "agg_seasonal_inventory",
    "win_market_speed",
    "win_value_by_year",
    "win_resale_lag",
    "win_rolling_median",
    "topk_price_high",
    "reg_value_by_year",
    "reg_horizon_value",
    "reg_cubic",
    "smooth_loess",
    "agg_violin_stats",
    "dash_all",
]


RUNS = 3  # the median leaves out the run that compiles code


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {"listing_snapshot": timed(lambda: Market(spark, sf_dir).listings)}
    for name in names:
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = statistics.median(timed(run) for _ in range(RUNS))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
