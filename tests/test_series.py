from __future__ import annotations

import loops
import numpy as np
import pandas as pd
import pytest
from conftest import collect, frame, same, walk
from pyspark.sql import functions as F

from tidebars.operators import indicators as ind
from tidebars.operators.blocks import BLOCK, OWN, ROW, blocked, carry_last, number_rows
from tidebars.operators.features import compute_features
from tidebars.schema import FEATURE_COLUMNS

LONG = 9000  # three blocks


@pytest.fixture(scope="module")
def long_walk():
    """A long series with a run of 2,500 bars that do not move, across a block border."""
    pdf = walk(LONG)
    flat = slice(3000, 5500)
    for c in ("open", "high", "low", "close"):
        pdf.loc[3000:5499, c] = pdf["close"].iloc[2999]
    assert (pdf["close"].iloc[flat].diff().dropna() == 0).all()
    return pdf


@pytest.fixture(scope="module")
def long_bars(spark, long_walk):
    other = walk(700, "EURUSD", seed=7)
    return frame(spark, pd.concat([long_walk, other])).cache()


def mine(df, *columns):
    return collect(df.filter("symbol = 'XAUUSD'"), *columns)


def test_blocks_number_rows_and_hold_their_halo(spark):
    pdf = walk(10000).drop(index=range(500, 700)).reset_index(drop=True)
    cut = blocked(frame(spark, pdf), back=100, fwd=50)
    own = cut.filter(OWN).select("ts", ROW).orderBy("ts").toPandas()
    assert own[ROW].tolist() == list(range(1, len(pdf) + 1))
    spans = cut.groupBy(BLOCK).agg(
        F.min(ROW).alias("lo"), F.max(ROW).alias("hi"), F.min(F.when(F.col(OWN), F.col(ROW))).alias("first"),
        F.max(F.when(F.col(OWN), F.col(ROW))).alias("last"), F.count("*").alias("n")).toPandas()
    for s in spans.itertuples():
        if s.first == s.first:  # blocks with rows of their own
            assert s.lo <= max(1, s.first - 100) and s.hi >= min(len(pdf), s.last + 50)
            assert s.n == s.hi - s.lo + 1 and s.n < 4096 + 2 * 256 + 150 + 512
    assert number_rows(frame(spark, pdf)).count() == len(pdf)


def test_blocks_refuse_long_look_back(spark):
    with pytest.raises(ValueError):
        blocked(frame(spark, walk(3)), back=4000)
    with pytest.raises(ValueError):
        blocked(frame(spark, walk(3)), keys=["symbol"])


def test_carry_last_over_empty_slices(spark):
    pdf = walk(9000)
    rows = frame(spark, pdf).withColumn("v", F.when(F.minute("ts") + F.hour("ts") + F.day("ts") == 2, F.col("close")))
    got = collect(carry_last(rows, {"v": "last"}), "v", "last")
    same(got["last"], got["v"].ffill())
    assert got["last"].notna().sum() > 8900


def test_rsi_across_blocks_and_flat_runs(long_bars, long_walk):
    got = mine(ind.rsi(long_bars), "rsi_14")
    same(got["rsi_14"], loops.rsi(long_walk["close"].to_numpy()), 1e-7)


def test_macd_and_atr_across_blocks(long_bars, long_walk):
    close, high, low = (long_walk[c].to_numpy() for c in ("close", "high", "low"))
    got = mine(ind.with_indicator(long_bars, ind.macd_stages(), ind.atr_stages()), "macd_line", "macd_signal", "atr_14")
    line, signal = loops.macd(close)
    same(got["macd_line"], line)
    same(got["macd_signal"], signal)
    same(got["atr_14"], loops.atr(high, low, close))


def test_adx_across_blocks_and_flat_runs(long_bars, long_walk):
    got = mine(ind.adx(long_bars), "adx_14")
    same(got["adx_14"], loops.adx(*(long_walk[c].to_numpy() for c in ("high", "low", "close"))), 1e-7)


def test_adx_waits_for_the_first_move(spark):
    pdf = walk(120)
    pdf.loc[:49, ["open", "high", "low", "close"]] = 2000.0
    got = collect(ind.adx(frame(spark, pdf)), "adx_14")
    same(got["adx_14"], loops.adx(*(pdf[c].to_numpy() for c in ("high", "low", "close"))))


def test_bollinger_and_returns(long_bars, long_walk):
    close = long_walk["close"]
    got = mine(ind.with_indicator(long_bars, ind.bollinger_stages(), ind.return_stages(), ind.momentum_stages(), back=60),
               "bb_middle", "bb_width", "bb_percent_b", "return_12bar", "momentum_48")
    same(got["bb_middle"], close.rolling(20).mean(), 1e-8)
    same(got["return_12bar"], np.log(close / close.shift(12)))
    same(got["momentum_48"], close / close.shift(48) - 1)
    assert (got["bb_width"].iloc[3050:5400] == 0).all() and (got["bb_percent_b"].iloc[3050:5400] == 0.5).all()


def test_volatility_skips_returns_that_do_not_exist(spark):
    pdf = walk(6000)
    rng = np.random.default_rng(1)
    pdf.loc[rng.choice(6000, 400, replace=False), "close"] = 0.0
    pdf.loc[2000:4600, "close"] = -1.0
    got = collect(ind.rolling_volatility(frame(spark, pdf)), "rolling_volatility_20")
    same(got["rolling_volatility_20"], loops.volatility(pdf["close"].to_numpy()))


@pytest.mark.parametrize("period", [1, 2, 3, 5, 50, 200])
def test_any_period(spark, period):
    """Fast averages need short blocks, slow ones long halos; 9,000 bars are several blocks of either."""
    pdf = walk(9000)
    close, high, low = (pdf[c].to_numpy() for c in ("close", "high", "low"))
    bars = frame(spark, pdf)
    same(collect(ind.rsi(bars, period, "x"), "x")["x"].astype(float), loops.rsi(close, period))
    same(collect(ind.atr(bars, period, "x"), "x")["x"].astype(float), loops.smoothed(loops.true_ranges(high, low, close), period, 1 / period))
    if period > 1:
        same(collect(ind.adx(bars, period, "x"), "x")["x"].astype(float), loops.adx(high, low, close, period))


def test_impossible_factors_and_dense_rows_are_errors(spark):
    with pytest.raises(ValueError):
        ind.macd(frame(spark, walk(60)), 2, 2000, 9)
    dense = walk(3000, minutes=1).assign(timeframe="1h")
    with pytest.raises(Exception, match="closer than their bar length"):
        ind.rsi(frame(spark, dense)).collect()


def test_input_order():
    assert list(FEATURE_COLUMNS) == (
        "rsi_14 rsi_7 macd_line macd_signal macd_histogram bb_percent_b bb_width atr_14 return_1bar return_5bar return_12bar "
        "rolling_volatility_20 momentum_48 is_london_session is_ny_session is_overlap_session is_asian_session hour_of_day "
        "day_of_week is_month_turn dxy_return_1h dxy_rsi_14 vix_level vix_change").split()


@pytest.mark.parametrize("n", [1, 13, 14, 15, 20, 26, 34, 35, 48, 49, 60])
def test_warm_up_edges(spark, n):
    pdf = walk(n)
    got = collect(compute_features(frame(spark, pdf), positive_prices=True), "rsi_14", "macd_signal", "atr_14",
                  "bb_middle", "momentum_48", "rolling_volatility_20", "warmup_complete")
    close, high, low = (pdf[c].to_numpy() for c in ("close", "high", "low"))
    same(got["rsi_14"].astype(float), loops.rsi(close))
    same(got["macd_signal"].astype(float), loops.macd(close)[1])
    same(got["atr_14"].astype(float), loops.atr(high, low, close))
    same(got["rolling_volatility_20"].astype(float), loops.volatility(close))
    assert got["warmup_complete"].tolist() == [i >= 48 for i in range(n)]


def test_monotone_and_constant_series(spark):
    up, flat = walk(60), walk(60, "EURUSD")
    up["close"] = np.arange(60) + 100.0
    for c in ("open", "high", "low", "close"):
        flat[c] = 5.0
    got = collect(compute_features(frame(spark, pd.concat([up, flat]))), "rsi_14", "bb_width", "bb_percent_b",
                  "rolling_volatility_20")
    rising, constant = got[got.symbol == "XAUUSD"], got[got.symbol == "EURUSD"]
    assert (rising["rsi_14"].dropna() == 100).all() and (constant["rsi_14"].dropna() == 100).all()
    assert (constant["bb_width"].dropna() == 0).all() and (constant["bb_percent_b"].dropna() == 0.5).all()
    assert (constant["rolling_volatility_20"].dropna() == 0).all()


def test_no_look_ahead_and_independent_series(spark):
    pdf, other = walk(300), walk(250, "EURUSD", seed=3)
    columns = ["rsi_14", "macd_histogram", "bb_percent_b", "atr_14", "return_5bar", "rolling_volatility_20", "momentum_48"]
    alone = collect(compute_features(frame(spark, pdf)), *columns)
    cut = collect(compute_features(frame(spark, pdf.head(200))), *columns)
    mixed = collect(compute_features(frame(spark, pd.concat([other, pdf]))), *columns)
    same(cut[columns], alone.head(200)[columns], 1e-12)
    same(mixed[mixed.symbol == "XAUUSD"][columns], alone[columns], 1e-12)
