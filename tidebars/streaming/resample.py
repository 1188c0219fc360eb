"""Resampling of bar streams.

``resample_stream`` leaves completeness to the watermark: a period is emitted once, after the
watermark has passed it; bars that come later are dropped. A feed that ends with ``session_end`` lets
out what is still open. ``resample_stream_early`` emits a period
with its last expected bar and the partial one when a bar of another period arrives, as a live feed
wants it; a bar that comes later opens its period again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebars.functions.bars import align
from tidebars.operators.resample import check_pair, resample
from tidebars.schema import BARS, timeframe_minutes

LIVE_SECONDS = 5  # a live feed sends 5-second bars, which are no timeframe of their own
SESSION_END = "9999-12-31 00:00:00"  # fixed value: later than any tick
_OUT = ("symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, "
        "volume double, is_complete boolean")
_STATE = "period timestamp, open double, high double, low double, close double, volume double, n int"


def _windowed(bars: DataFrame, seconds: int, needed: int, label: str, delay: str) -> DataFrame:
    return (
        bars.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("_w"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("_n"))
        .select("symbol", F.lit(label).alias("timeframe"), F.col("_w.start").alias("ts"), "open", "high", "low", "close",
                "volume", (F.col("_n") == needed).alias("is_complete"))
    )


def resample_stream(bars: DataFrame, source: str, target: str, delay: str = "1 minute") -> DataFrame:
    needed = check_pair(source, target)
    return _windowed(bars.filter(F.col("timeframe") == source), timeframe_minutes(target) * 60, needed, target, delay)


def live_to_minutes(live: DataFrame, target: str = "1m", delay: str = "10 seconds") -> DataFrame:
    """Bars of a timeframe from live 5-second bars whose prices are text."""
    seconds = timeframe_minutes(target) * 60
    typed = live.select("symbol", "ts", *[F.col(c).try_cast("double").alias(c)
                                          for c in ("open", "high", "low", "close", "volume")])
    whole = typed.na.drop(subset=["open", "high", "low", "close"]).na.fill(0.0, ["volume"])
    return _windowed(whole, seconds, seconds // LIVE_SECONDS, target, delay)


def ticks_to_bars(ticks: DataFrame, timeframe: str, delay: str = "1 minute") -> DataFrame:
    """Bars of a stream of (symbol, ts, price)."""
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", f"{timeframe_minutes(timeframe)} minutes").alias("_w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_w.start").alias("ts"), "open", "high", "low",
                "close", "volume", F.lit(True).alias("is_complete"))
    )


def session_end(spark: SparkSession, schema: T.StructType, ts: str = "ts") -> DataFrame:
    """The row that a feed ends with: its time moves the watermark past every period, its own never closes."""
    return spark.range(1).select(*[
        (F.lit(SESSION_END) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def open_tail(whole: DataFrame, emitted: DataFrame) -> DataFrame:
    """Periods of a batch result that a stream has not emitted yet: what a flush at session end gives."""
    return whole.join(emitted.select("symbol", "timeframe", "ts"), ["symbol", "timeframe", "ts"], "left_anti")


def flush(bars: DataFrame, emitted: DataFrame, source: str, target: str) -> DataFrame:
    return open_tail(resample(bars, source, target), emitted)


def resample_stream_early(bars: DataFrame, source: str, target: str) -> DataFrame:
    """Exact live behaviour, one small state per symbol: the bar being built."""
    needed = check_pair(source, target)
    seconds = timeframe_minutes(target) * 60
    rows = bars.filter(F.col("timeframe") == source).select(
        *[c for c in BARS.fieldNames() if c not in ("timeframe", "is_complete")], align("ts", seconds).alias("period"))

    def build(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = list(state.get) if state.exists else None
        done: list[tuple] = []

        def close_period() -> None:
            period, o, h, l, c, v, n = current
            done.append((key[0], target, period, o, h, l, c, v, n == needed))

        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            if current is not None and current[0] != row.period:
                close_period()
                current = None
            if current is None:
                current = [row.period, row.open, row.high, row.low, row.close, row.volume, 1]
            else:
                _, o, h, l, _, v, n = current
                current = [row.period, o, max(h, row.high), min(l, row.low), row.close, v + row.volume, n + 1]
            if current[6] == needed:
                close_period()
                current = None
        if current is not None:
            state.update(tuple(current))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=BARS.fieldNames())

    return rows.groupBy("symbol").applyInPandasWithState(build, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
