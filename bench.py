"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from barloom.plans import catalog

HEADLINE = ("ohlcv_daily", "ohlcv_hourly", "resample_weekly", "trailing_365d", "ema_200", "indicators_full", "prices_with_indicators", "fingerprint_changed", "pullback_events", "turn_trigger", "similarity_topk")


def calibration(spark: SparkSession) -> None:
    """A fixed piece of work without any of this engine's code, to tell a slower machine from a slower engine."""
    rows = spark.range(0, 5_000_000, 1, 8).selectExpr("id % 1000 AS k", "xxhash64(id) AS v")
    rows.groupBy("k").agg({"v": "max"}).selectExpr("k", "`max(v)` AS m").join(rows, "k").where("v = m").write.format("noop").mode("overwrite").save()


def main(runs: int = 3) -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, plain = {}, []
    for _ in range(runs):
        began = time.perf_counter()
        calibration(spark)
        plain.append(time.perf_counter() - began)
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            spark.catalog.clearCache()
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times), 3)
    print(json.dumps({"metric": "total_headline_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "calibration": round(median(plain), 3), "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
