"""Running curves and performance numbers of trades and of classifier folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators.blocks import time_bucket

# fixed values
TRADE_PERIODS = 252 * 6.5
BAR_PERIODS = 252 * 78
PROFIT_CAP = 99.99
MINIMUM = {"sharpe_ratio": 1.0, "sortino_ratio": 1.5, "profit_factor": 1.3, "win_rate": 0.40,
           "max_drawdown": 0.20, "trade_count": 100}
TARGET = {"sharpe_ratio": 1.5, "sortino_ratio": 2.0, "profit_factor": 1.5, "win_rate": 0.50,
          "max_drawdown": 0.15, "trade_count": 200}


def _signed_product(factor: Column, window=None) -> Column:
    """Product of factors of any sign, as logs of sizes, a count of negatives and a count of zeros."""
    def over(c: Column) -> Column:
        return c.over(window) if window is not None else c

    size = over(F.sum(F.when(factor != 0, F.ln(F.abs(factor))).otherwise(0.0)))
    negatives = over(F.sum(F.when(factor < 0, 1).otherwise(0)))
    zeros = over(F.sum(F.when(factor == 0, 1).otherwise(0)))
    return F.when(zeros > 0, 0.0).otherwise(F.exp(size) * F.when(negatives % 2 == 1, -1.0).otherwise(1.0))


def running_curve(
    df: DataFrame, value: str, keys: Sequence[str], ts: str, step: int, compound: bool,
    bars: int = 4096,
) -> DataFrame:
    """``equity``, ``peak`` and ``drawdown`` of a series of returns, from its first row on.

    Additive: running sum, drawdown ``peak - equity``. Compound: running product of ``1 + value``,
    drawdown ``(peak - equity) / peak``. Curves are built per time slice; what crosses slices is one
    row each (total, highest and lowest point).
    """
    keys, part = list(keys), "_slice"
    w = Window.partitionBy(*keys, part).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    cut = df.withColumn(part, time_bucket(bars, keys, ts, step))
    here = _signed_product(1 + F.col(value), w) if compound else F.sum(value).over(w)
    local = cut.withColumn("_eq", here).withColumns({"_up": F.max("_eq").over(w), "_down": F.min("_eq").over(w)})
    ends = local.groupBy(*keys, part).agg(
        F.max_by("_eq", ts).alias("_total"), F.max("_eq").alias("_hi"), F.min("_eq").alias("_lo"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(_signed_product(F.col("_total"), before), F.lit(1.0)) if compound \
        else F.coalesce(F.sum("_total").over(before), F.lit(0.0))

    def reach(high: str, low: str) -> Column:
        if not compound:
            return F.col("_base") + F.col(high)
        return F.when(F.col("_base") >= 0, F.col("_base") * F.col(high)).otherwise(F.col("_base") * F.col(low))

    carry = ends.withColumn("_base", base).withColumn("_top", reach("_hi", "_lo"))
    carry = carry.select(*keys, part, "_base", F.max("_top").over(before).alias("_past"))
    joined = local.join(carry, [*keys, part])
    equity = F.col("_base") * F.col("_eq") if compound else F.col("_base") + F.col("_eq")
    out = joined.withColumns({"equity": equity, "peak": F.greatest(F.col("_past"), reach("_up", "_down"))})
    drop = F.col("peak") - F.col("equity")
    drawdown = drop / F.nullif(F.col("peak"), F.lit(0.0)) if compound else drop
    return out.withColumn("drawdown", drawdown).drop(part, "_eq", "_up", "_down", "_base", "_past")


def _ratio(mean: Column, spread: Column, scale: Column) -> Column:
    return F.when((spread > 0) & (scale > 0), mean / F.nullif(spread, F.lit(0.0)) * F.sqrt(scale)).otherwise(0.0)


def trade_metrics(trades: DataFrame, keys: Sequence[str] = ("symbol", "timeframe"), step: int = 300,
                  periods: float = TRADE_PERIODS) -> DataFrame:
    """One row of performance numbers per group, unrounded; trades need pnl_pct, bars_held and exit_ts.

    Trades without P&L count, but enter no other number. Zero P&L counts as a loss.
    """
    keys = list(keys)
    p = F.col("pnl_pct")
    sums = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.count(p).alias("_n"),
        _signed_product(1 + p / 100).alias("_growth"),
        F.avg(F.when(p > 0, 1.0).otherwise(F.when(p.isNotNull(), 0.0))).alias("_wins"),
        F.avg(F.when(p > 0, p)).alias("_avg_win"),
        F.avg(F.when(p <= 0, p)).alias("_avg_loss"),
        F.max(p).alias("_best"), F.min(p).alias("_worst"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("_gain"),
        F.abs(F.sum(F.when(p <= 0, p).otherwise(0.0))).alias("_loss"),
        F.count_if(p > 0).alias("_n_win"), F.count_if(p <= 0).alias("_n_loss"),
        F.count_if(p < 0).alias("_n_down"),
        F.avg(p).alias("_mean"), F.stddev_samp(p).alias("_sd"), F.stddev_samp(F.when(p < 0, p)).alias("_down_sd"),
        F.avg(F.when(p.isNotNull(), F.col("bars_held"))).alias("_held"),
    )
    closed = trades.filter(p.isNotNull()).withColumn("_r", p / 100)
    falls = running_curve(closed, "_r", keys, "exit_ts", step, compound=True).groupBy(*keys).agg(
        F.max("drawdown").alias("_dd"))
    scale = F.lit(periods) / F.nullif(F.col("_held"), F.lit(0.0))
    sharpe = F.when(F.col("_n") > 1, _ratio(F.col("_mean"), F.col("_sd"), scale)).otherwise(0.0)
    sortino = F.when(F.col("_n") <= 1, 0.0).when(
        F.col("_n_down") > 0, _ratio(F.col("_mean"), F.col("_down_sd"), scale),
    ).otherwise(F.when(sharpe > 0, sharpe * 2.0).otherwise(0.0))
    factor = (
        F.when((F.col("_n_loss") > 0) & (F.col("_loss") > 0),
               F.least(F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0)), F.lit(PROFIT_CAP)))
        .when((F.col("_n_loss") > 0) | (F.col("_n_win") > 0), PROFIT_CAP).otherwise(0.0))
    some = F.col("_n") > 0

    def known(c: Column) -> Column:
        return F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0)

    return sums.join(falls, keys, "left").select(
        *keys,
        known((F.col("_growth") - 1) * 100).alias("total_return"), known(sharpe).alias("sharpe_ratio"),
        known(sortino).alias("sortino_ratio"), known(factor).alias("profit_factor"),
        known(F.col("_wins") * 100).alias("win_rate"), known(F.col("_dd") * 100).alias("max_drawdown"),
        "trade_count", known(F.col("_avg_win")).alias("avg_win"), known(F.col("_avg_loss")).alias("avg_loss"),
        known(F.col("_best")).alias("best_trade"), known(F.col("_worst")).alias("worst_trade"))


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """Numbers as reports show them: one digit for win_rate and max_drawdown, two for the others."""
    one = {"win_rate", "max_drawdown"}
    return metrics.select(*[
        F.bround(F.col(c), 1 if c in one else 2).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])


def regime_breakdown(trades: DataFrame, keys: Sequence[str] = ("symbol", "timeframe"),
                     periods: float = TRADE_PERIODS) -> DataFrame:
    """Trades, win rate, Sharpe and compound return per regime, for closed trades with a regime."""
    p = F.col("pnl_pct")
    grouped = trades.filter(F.col("regime_state").isNotNull() & p.isNotNull()).groupBy(*keys, "regime_state").agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg(F.when(p > 0, 100.0).otherwise(0.0)).alias("win_rate"),
        _signed_product(1 + p / 100).alias("_growth"), F.avg(p).alias("_mean"), F.stddev_samp(p).alias("_sd"),
        F.avg("bars_held").alias("_held"))
    scale = F.lit(periods) / F.nullif(F.col("_held"), F.lit(0.0))
    sharpe = F.when(F.col("trade_count") > 1, _ratio(F.col("_mean"), F.col("_sd"), scale)).otherwise(0.0)
    return grouped.select(*keys, "regime_state", "trade_count", "win_rate", F.coalesce(sharpe, F.lit(0.0)).alias(
        "sharpe_ratio"), ((F.col("_growth") - 1) * 100).alias("total_return"))


def direction_breakdown(trades: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Trades, wins, profit factor (losses strictly below zero) and summed return per side."""
    p = F.col("pnl_pct")
    grouped = trades.filter(p.isNotNull()).groupBy(*keys, "direction").agg(
        F.count(F.lit(1)).alias("trade_count"), F.count_if(p > 0).alias("win_count"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("_gain"), F.abs(F.sum(F.when(p < 0, p).otherwise(0.0))).alias("_loss"),
        F.sum(p).alias("total_return"))
    factor = F.when(F.col("_loss") > 0, F.least(F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0)), F.lit(PROFIT_CAP))
                    ).when(F.col("win_count") > 0, PROFIT_CAP).otherwise(0.0)
    return grouped.select(*keys, "direction", "trade_count", "win_count",
                          (F.col("win_count") / F.col("trade_count") * 100).alias("win_rate"),
                          factor.alias("profit_factor"), "total_return")


def fold_metrics(scored: DataFrame, keys: Sequence[str], step: int, horizon: int = 1,
                 periods: float = BAR_PERIODS) -> DataFrame:
    """Classifier metrics per group of rows with ``prediction``, ``label``, ``forward_return`` and ``ts``."""
    keys = list(keys)
    r = F.col("_r")
    rows = scored.withColumn("_r", F.when(F.col("prediction") == 1, 1.0).otherwise(-1.0) * F.col("forward_return"))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"), F.count_if(r < 0).alias("_n_down"),
        F.count_if(r > 0).alias("_n_up"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_gain"),
        F.abs(F.sum(F.when(r < 0, r).otherwise(0.0))).alias("_loss"), F.sum(r).alias("total_return"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    falls = running_curve(rows, "_r", keys, "ts", step, compound=False).groupBy(*keys).agg(
        F.max("drawdown").alias("max_drawdown"))
    yearly = F.lit(periods / max(horizon, 1))
    sd = F.when(F.col("trade_count") > 1, F.col("_sd")).otherwise(1.0)
    down = F.when(F.col("_n_down") > 1, F.col("_down")).otherwise(1.0)
    loss = F.when(F.col("_n_down") > 0, F.col("_loss")).otherwise(1.0)
    return sums.join(falls, keys).select(
        *keys, _ratio(F.col("mean_return"), sd, yearly).alias("sharpe_ratio"),
        _ratio(F.col("mean_return"), down, yearly).alias("sortino_ratio"),
        (F.col("_gain") / loss).alias("profit_factor"), (F.col("_n_up") / F.col("trade_count")).alias("win_rate"),
        "max_drawdown", "trade_count", "total_return", "mean_return", sd.alias("std_return"), "accuracy")


def meets(thresholds: dict[str, float] = MINIMUM) -> Column:
    """All thresholds reached; the drawdown has to stay at or below its own."""
    ok = F.lit(True)
    for name, value in thresholds.items():
        ok = ok & (F.col(name) <= value if name == "max_drawdown" else F.col(name) >= value)
    return ok


def backtest_accepted() -> Column:
    """The gate of backtest reports: rounded numbers, win rate in percent, no drawdown or count rule."""
    return ((F.col("sharpe_ratio") >= 1.0) & (F.col("sortino_ratio") >= 1.5) & (F.col("profit_factor") >= 1.3)
            & (F.col("win_rate") >= 40.0))
