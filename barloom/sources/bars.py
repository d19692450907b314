"""Bars derived from the benchmark tables: daily from orders, hourly from events; and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, order: Column) -> DataFrame:
    """One bar per symbol and time; open and close by ``order``, volume is the number of ticks."""
    return ticks.groupBy(symbol.alias("symbol"), ts.alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("volume")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return to_bars(orders.join(customer, "o_custkey"), F.col("c_mktsegment"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return to_bars(events, F.col("event_type"), hour, F.col("value"), F.struct("ts", "event_id"))


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a longer interval (a ``date_trunc`` unit): first open, highest, lowest, last close, volumes."""
    start = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return bars.groupBy("symbol", start.alias("ts")).agg(
        F.min_by("open", bars["ts"]).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", bars["ts"]).alias("close"), F.sum("volume").alias("volume")
    )
