"""Features of one instrument taken from others (an index and a volatility gauge)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import HALO, block_window, blocked, carry_last, own_rows, run_stages
from tidebars.operators.indicators import rsi_stages, settle
from tidebars.schema import SERIES

COLUMNS = ["dxy_return_1h", "dxy_rsi_14", "vix_level", "vix_change"]


def _change(bars: int) -> Column:
    old = F.lag("close", bars).over(block_window())
    return F.when(old != 0, (F.col("close") - old) / F.nullif(old, F.lit(0.0)))


def cross_asset(bars: DataFrame, base: str, index: str, gauge: str, lookback: int = 12) -> DataFrame:
    """Cross-asset columns at every bar of ``base``.

    Only index and gauge bars at the time of a base bar count, so look-backs run over matched bars;
    between matches the last values stay in force.
    """
    wide = (
        bars.filter(F.col("symbol").isin(base, index, gauge))
        .groupBy("timeframe", "ts")
        .agg(F.count_if(F.col("symbol") == base).alias("_base"),
             F.max(F.when(F.col("symbol") == index, F.col("close"))).alias("_index"),
             F.max(F.when(F.col("symbol") == gauge, F.col("close"))).alias("_gauge"))
        .filter(F.col("_base") > 0)
        .select(F.lit(base).alias("symbol"), "timeframe", "ts", "_index", "_gauge")
    )

    def matched(column: str) -> DataFrame:
        return wide.filter(F.col(column).isNotNull()).select(*SERIES, "ts", F.col(column).alias("close"))

    of_index = own_rows(settle(run_stages(
        blocked(matched("_index"), back=HALO),
        rsi_stages(14, "dxy_rsi_14"), [{"dxy_return_1h": _change(lookback)}],
    ), ["dxy_rsi_14"]))
    of_gauge = own_rows(blocked(matched("_gauge"), back=lookback).withColumn("vix_change", _change(lookback)))
    of_gauge = of_gauge.withColumnRenamed("close", "vix_level")
    # a matched row whose own value does not exist must hide the value before it, hence the structs
    joined = (
        wide.select(*SERIES, "ts")
        .join(of_index.select(*SERIES, "ts", F.struct("dxy_return_1h", "dxy_rsi_14").alias("_i")), [*SERIES, "ts"], "left")
        .join(of_gauge.select(*SERIES, "ts", F.struct("vix_level", "vix_change").alias("_g")), [*SERIES, "ts"], "left")
    )
    filled = carry_last(joined, {"_i": "_fi", "_g": "_fg"})
    return filled.select(*SERIES, "ts", "_fi.*", "_fg.*").select(*SERIES, "ts", *COLUMNS)
