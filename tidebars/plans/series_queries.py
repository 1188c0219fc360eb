"""Registered queries: bars, indicators, features and calendar columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.bars import bar_shape, holding_period, holding_period_bars
from tidebars.functions.sessions import hour_between, with_session_rules, with_time_features
from tidebars.operators import indicators as ind
from tidebars.operators import resample as rs
from tidebars.operators.features import compute_features
from tidebars.plans.common import rounded
from tidebars.sources.driver_tables import event_bars, event_ticks, order_bars

BAR = ["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"]


def bars_1h(spark: SparkSession, folder: str) -> DataFrame:
    return event_bars(spark, folder, "1h").select(*BAR)


def bars_5m(spark: SparkSession, folder: str) -> DataFrame:
    return event_bars(spark, folder, "5m").select(*BAR)


def resample_4h(spark: SparkSession, folder: str) -> DataFrame:
    return rs.resample(event_bars(spark, folder, "1h"), "1h", "4h")


def multi_timeframe(spark: SparkSession, folder: str) -> DataFrame:
    return rs.resample_many(event_bars(spark, folder, "5m"), "5m", ["15m", "1h", "4h"], keep_source=True)


def daily_sample(spark: SparkSession, folder: str) -> DataFrame:
    return rs.sample_daily(event_bars(spark, folder, "5m"))


def daily_sample_mixed(spark: SparkSession, folder: str) -> DataFrame:
    bars = rs.resample_many(event_bars(spark, folder, "5m"), "5m", ["15m", "1h"], keep_source=True)
    return rs.sample_daily(bars, timeframe=None)


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    return order_bars(spark, folder).select(*BAR)


def bar_shapes(spark: SparkSession, folder: str) -> DataFrame:
    shaped = bar_shape(event_bars(spark, folder, "5m"))
    return rounded(shaped.select("symbol", "ts", "mid_price", "typical_price", "range", "body", "is_bullish"))


def rsi_14(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.rsi(event_bars(spark, folder, "1h")).select("symbol", "ts", "rsi_14"))


def rsi_7(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.rsi(event_bars(spark, folder, "1h"), 7, "rsi_7").select("symbol", "ts", "rsi_7"))


def rsi_2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.rsi(event_bars(spark, folder, "5m"), 2, "rsi_2").select("symbol", "ts", "rsi_2"))


def rsi_200(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.rsi(event_bars(spark, folder, "5m"), 200, "rsi_200").select("symbol", "ts", "rsi_200"))


def atr_5(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.atr(event_bars(spark, folder, "5m"), 5, "atr_5").select("symbol", "ts", "atr_5"))


def macd(spark: SparkSession, folder: str) -> DataFrame:
    out = ind.macd(event_bars(spark, folder, "1h"))
    return rounded(out.select("symbol", "ts", "macd_line", "macd_signal", "macd_histogram"))


def macd_5_35_5(spark: SparkSession, folder: str) -> DataFrame:
    out = ind.macd(event_bars(spark, folder, "5m"), 5, 35, 5)
    return rounded(out.select("symbol", "ts", "macd_line", "macd_signal", "macd_histogram"))


def atr_14(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.atr(event_bars(spark, folder, "1h")).select("symbol", "ts", "atr_14"))


def adx_14(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.adx(event_bars(spark, folder, "1h")).select("symbol", "ts", "adx_14"))


def bollinger(spark: SparkSession, folder: str) -> DataFrame:
    out = ind.bollinger(event_bars(spark, folder, "5m"))
    return rounded(out.select("symbol", "ts", "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_percent_b"))


def log_returns(spark: SparkSession, folder: str) -> DataFrame:
    out = ind.log_returns(event_bars(spark, folder, "5m"))
    return rounded(out.select("symbol", "ts", "return_1bar", "return_5bar", "return_12bar"))


def rolling_vol(spark: SparkSession, folder: str) -> DataFrame:
    out = ind.rolling_volatility(event_bars(spark, folder, "5m"))
    return rounded(out.select("symbol", "ts", "rolling_volatility_20"))


def momentum(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.momentum(event_bars(spark, folder, "5m")).select("symbol", "ts", "momentum_48"), 8)


def atr_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ind.rolling_mean_atr(event_bars(spark, folder, "5m")).select("symbol", "ts", "atr_mean"))


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: all features of all event series at 1h."""
    return rounded(compute_features(event_bars(spark, folder, "1h")))


def session_flags(spark: SparkSession, folder: str) -> DataFrame:
    ticks = with_session_rules(with_time_features(event_ticks(spark, folder)))
    return ticks.select(
        "symbol", "ts", "is_london_session", "is_ny_session", "is_overlap_session", "is_asian_session",
        hour_between("ts", 23, 2).alias("around_midnight"),
        F.col("hour_of_day").cast("long").alias("hour_of_day"),
        F.col("day_of_week").cast("long").alias("day_of_week"),
        "session_class", "session_bias", "session_reason", "avoid_trading",
    )


def month_turn(spark: SparkSession, folder: str) -> DataFrame:
    days = with_time_features(order_bars(spark, folder))
    return days.groupBy("symbol", "is_month_turn").agg(F.count(F.lit(1)).alias("days"),
                                                       F.min("ts").alias("first_day"), F.max("ts").alias("last_day"))


def holding_periods(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("volume").cast("long")
    return event_bars(spark, folder, "1h").groupBy(n.alias("bars")).agg(F.count(F.lit(1)).alias("n")).select(
        "bars", "n", holding_period("bars").alias("horizon"),
        holding_period_bars(holding_period("bars")).cast("long").alias("horizon_bars"),
    )


def weekend_gaps(spark: SparkSession, folder: str) -> DataFrame:
    out = rs.weekend_gaps(order_bars(spark, folder).filter(F.weekday("ts") < 5))
    return out.filter("weekend_gap").select("symbol", "ts")


QUERIES = {
    f.__name__: f for f in (
        bars_1h, bars_5m, resample_4h, multi_timeframe, daily_sample, daily_sample_mixed, daily_bars, bar_shapes,
        rsi_14, rsi_7, rsi_2, rsi_200, macd, macd_5_35_5, atr_14, atr_5, adx_14, bollinger, log_returns, rolling_vol, momentum, atr_mean, feature_table,
        session_flags, month_turn, holding_periods, weekend_gaps,
    )
}
