"""Registered queries: streams replayed over the events and drained into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.bars import align
from tidebars.plans.common import rounded
from tidebars.schema import BARS
from tidebars.session import prepare
from tidebars.sources.driver_tables import event_bars, event_ticks, read_table
from tidebars.streaming.features import features_stream, regime_stream
from tidebars.streaming.publish import append_to, as_records, fan_out, upsert_latest
from tidebars.streaming.replay import drain, drain_batches, scratch, stream_parquet
from tidebars.streaming.resample import live_to_minutes, open_tail, resample_stream_early, session_end, ticks_to_bars
from tidebars.streaming.signals import decisions, signal_handler

SLICES = 3


def _bar_files(spark: SparkSession, folder: str, timeframe: str) -> str:
    """Bars written as a feed would leave them: one slice of days after the other."""
    path = scratch(spark, "feed")
    bars = event_bars(spark, folder, timeframe).withColumn("_slice", F.floor((F.day("ts") - 1) / (30 / SLICES)))
    for i in range(SLICES + 1):
        part = bars.filter(F.col("_slice") == i).drop("_slice")
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _bar_stream(spark: SparkSession, folder: str, timeframe: str) -> DataFrame:
    return stream_parquet(spark, _bar_files(spark, folder, timeframe), BARS, files_per_batch=1)


def _event_stream(spark: SparkSession, folder: str, closing: bool = False) -> DataFrame:
    """Ticks of the events in files of one span of time after the other; ``closing`` ends the session after the last."""
    prepare(spark)
    feed = scratch(spark, "ticks")
    ticks = event_ticks(spark, folder)
    first, last = ticks.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    span = ((last or 0) - (first or 0)) // (SLICES + 1) + 1
    for i in range(SLICES + 1):
        part = ticks.filter(F.floor((F.unix_micros("ts") - F.lit(first or 0)) / F.lit(span)) == i)
        part.coalesce(1).write.mode("append").parquet(feed)
    if closing:
        session_end(spark, ticks.schema).coalesce(1).write.mode("append").parquet(feed)
    return stream_parquet(spark, feed, ticks.schema, files_per_batch=1)


def stream_bars(spark: SparkSession, folder: str) -> DataFrame:
    """1h bars of the event stream, whose session end lets the last hours out; nothing is added from elsewhere."""
    return drain(ticks_to_bars(_event_stream(spark, folder, closing=True), "1h"), scratch(spark, "bars"))


def stream_flush(spark: SparkSession, folder: str) -> DataFrame:
    """What a flush at session end adds to the stream: the hours that it still holds open."""
    emitted = drain(ticks_to_bars(_event_stream(spark, folder), "1h"), scratch(spark, "bars"))
    return open_tail(event_bars(spark, folder, "1h"), emitted).drop("is_complete")


def stream_live(spark: SparkSession, folder: str) -> DataFrame:
    """1h bars from live 5-second bars whose prices are text, as far as the watermark has let them out."""
    feed = scratch(spark, "live")
    seconds = align("ts", 5)
    live = event_ticks(spark, folder).groupBy("symbol", seconds.alias("start")).agg(
        F.min_by("price", "ts").cast("string").alias("open"), F.max("price").cast("string").alias("high"),
        F.min("price").cast("string").alias("low"), F.max_by("price", "ts").cast("string").alias("close"),
        F.count(F.lit(1)).cast("string").alias("volume")).withColumnRenamed("start", "ts")
    for i in range(SLICES + 1):
        live.filter(F.floor((F.day("ts") - 1) / (30 / SLICES)) == i).coalesce(1).write.mode("append").parquet(feed)
    rows = stream_parquet(spark, feed, spark.read.parquet(feed).schema, files_per_batch=1)
    return drain(live_to_minutes(rows, "1h"), scratch(spark, "bars"))


def stream_resample_early(spark: SparkSession, folder: str) -> DataFrame:
    """4h bars the moment they are full or the next period begins; the last period is still open."""
    out = drain(resample_stream_early(_bar_stream(spark, folder, "1h"), "1h", "4h"), scratch(spark, "early"))
    return out


def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    out = drain(features_stream(_bar_stream(spark, folder, "1h")), scratch(spark, "features"))
    return rounded(out)


def stream_regime(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions on 1h bars, with the bar's own range as ATR."""
    bars = _bar_stream(spark, folder, "1h").withColumn("atr_14", F.col("high") - F.col("low") + 1)
    out = drain(regime_stream(bars), scratch(spark, "regime"))
    return rounded(out.select("symbol", "ts", "state", "confidence", "position_multiplier", "should_trade", "adx_value",
                              "recent_change"))


def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "latest")
    drain_batches(_bar_stream(spark, folder, "5m"), upsert_latest(path), scratch(spark, "progress"))
    return spark.read.parquet(path).select("symbol", "timeframe", "ts", "close", "volume")


def stream_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Records per topic that reached each of two subscribers."""
    mine, all_bars = scratch(spark, "clicks"), scratch(spark, "all")
    handler = fan_out({"bar.click": [append_to(mine)], "bar.": [append_to(all_bars)]})
    drain_batches(as_records(_bar_stream(spark, folder, "1h"), "bar"), handler, scratch(spark, "progress"))
    read = spark.read.schema("topic string, value string, event_time string")
    both = read.json(mine).select(F.lit("clicks").alias("subscriber"), "topic").unionByName(
        read.json(all_bars).select(F.lit("all").alias("subscriber"), "topic"))
    return both.groupBy("subscriber", "topic").agg(F.count(F.lit(1)).alias("records"))


def _rule(rows: DataFrame) -> DataFrame:
    """A stand-in scorer: RSI below 45 buys, above 55 sells."""
    side = F.when(F.col("rsi_14") < 45, "long").when(F.col("rsi_14") > 55, "short").otherwise("neutral")
    return rows.withColumns({"direction": side, "confidence": F.abs(F.col("rsi_14") - 50) / 50,
                             "predicted_horizon": F.lit("2h")})


def stream_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Decision and signal records of the live job, per topic."""
    prepare(spark)
    features = scratch(spark, "features")
    drain(features_stream(_bar_stream(spark, folder, "1h")), features)
    schema = spark.read.parquet(features).schema
    out = scratch(spark, "signals")
    drain_batches(decisions(stream_parquet(spark, features, schema)), signal_handler(_rule, append_to(out)),
                  scratch(spark, "progress"))
    records = spark.read.schema("topic string, value string, event_time string").json(out)
    return records.groupBy("topic").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {
    f.__name__: f for f in (
        stream_bars, stream_flush, stream_live, stream_resample_early, stream_features, stream_regime, stream_latest, stream_topics, stream_signals)
}
