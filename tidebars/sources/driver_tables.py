"""Bars derived from the star-schema tables: event types and order priorities act as symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators.resample import bars_from_ticks
from tidebars.session import prepare


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def event_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price")
    )


def event_bars(spark: SparkSession, folder: str, timeframe: str = "1h") -> DataFrame:
    """Bars of the five event types; open and close by time, volume counts events."""
    return bars_from_ticks(event_ticks(spark, folder), timeframe)


def order_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per order priority; open and close by order key."""
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("price"), "o_orderkey",
    )
    return bars_from_ticks(orders, "1d", order="o_orderkey")
