"""Merging overlapping fetches of the same series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_batches(fetched: DataFrame, keys: Sequence[str] = ("symbol", "timeframe"), ts: str = "ts",
                  batch: str = "batch_no") -> DataFrame:
    """One row per key and time, from the earliest batch. A negative volume means "not available".

    ``min_by`` combines on the map side, so a time that many batches repeat stays cheap.
    """
    values = [c for c in fetched.columns if c not in {*keys, ts}]
    clean = fetched
    if "volume" in fetched.columns:
        clean = fetched.withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))
    picked = clean.groupBy(*keys, ts).agg(
        F.min_by(F.struct(*values), batch).alias("_row"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return picked.select(*keys, ts, "_row.*", "duplicates")


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count(F.lit(1)).alias("rows_loaded"), F.sum("duplicates").alias("rows_skipped"),
        F.min("ts").alias("start_date"), F.max("ts").alias("end_date"))


def day_stamp(column: str) -> F.Column:
    """A date without a time is midnight UTC."""
    return F.to_timestamp(F.to_date(F.col(column)))
