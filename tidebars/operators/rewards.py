"""Rewards of ledger rows. A reward is a function from a ledger DataFrame to one with a reward column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import ROW, block_window, blocked, decay_scan, own_rows
from tidebars.operators.ledger import AT, FLAT, KEYS
from tidebars.schema import SERIES

Reward = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PnlWeights:
    """Fixed values of the plain reward."""

    realized: float = 1.0
    unrealized: float = 0.5
    flat: float = -0.0001
    by_atr: bool = False
    atr_multiple: float = 0.1


@dataclass(frozen=True)
class RiskWeights:
    """Fixed values of the risk adjustments (the threshold is compared with a percentage as it is)."""

    drawdown_threshold: float = 0.02
    drawdown_scale: float = 10.0
    regime_bonus: float = 0.1
    change_penalty: float = -0.02
    max_hold: int = 48
    hold_penalty: float = -0.0002


@dataclass(frozen=True)
class SharpeWeights:
    """Fixed values of the differential Sharpe reward."""

    eta: float = 0.01
    warmup: int = 20
    scale: float = 100.0
    min_variance: float = 1e-6


def pnl_value(w: PnlWeights = PnlWeights()) -> Column:
    closed, position, atr = F.col("trade_closed"), F.col("position"), F.col("atr_14")
    reward = F.when(closed, F.col("realized_pnl") * w.realized).when(
        position != FLAT, F.col("unrealized_pnl") * w.unrealized).otherwise(w.flat)
    if w.by_atr:
        scaled = F.coalesce(atr > 0, F.lit(False)) & (closed | (position != FLAT))
        reward = F.when(scaled, reward / F.nullif(atr * w.atr_multiple, F.lit(0.0))).otherwise(reward)
    return reward


def pnl_reward(ledger: DataFrame, w: PnlWeights = PnlWeights(), name: str = "reward") -> DataFrame:
    """Realized result when a trade closes, part of the open result while one is open, a small cost when flat."""
    return ledger.withColumn(name, pnl_value(w))


def risk_reward(ledger: DataFrame, w: RiskWeights = RiskWeights(), base: Column | None = None,
                name: str = "reward") -> DataFrame:
    """The base reward with drawdown, regime, position-change and long-hold adjustments."""
    dd, regime, position = F.col("drawdown_pct"), F.col("regime_state"), F.col("position")
    aligned = F.when(regime.isin("low_vol_trend", "high_vol_trend"), w.regime_bonus).when(
        regime == "ranging", -w.regime_bonus).otherwise(0.0)
    return ledger.withColumn(name, (
        (pnl_value() if base is None else base)
        - F.when(dd > w.drawdown_threshold, (dd - w.drawdown_threshold) * w.drawdown_scale).otherwise(0.0)
        + F.when(regime.isNotNull() & (position != FLAT), aligned).otherwise(0.0)
        + F.when(position != F.col("previous_position"), w.change_penalty).otherwise(0.0)
        + F.when(F.col("bars_held") > w.max_hold, (F.col("bars_held") - w.max_hold) * w.hold_penalty).otherwise(0.0)))


def sharpe_reward(ledger: DataFrame, w: SharpeWeights = SharpeWeights(), name: str = "reward") -> DataFrame:
    """Differential Sharpe ratio of balance changes, clipped to [-1, 1]; 0 while it warms up.

    Both averages are linear recurrences, so they come from the block scan; with a decay of 0.99 the
    halo has to be longer than for the indicators.
    """
    rows, back = 16384, 4352  # 0.99^4352 < 1e-18
    q, rn = 1 - w.eta, F.col(ROW)
    win = block_window(KEYS, AT)
    cut = blocked(ledger.withColumn(AT, F.timestamp_seconds(F.col("step").cast("long"))), back=back, keys=KEYS, ts=AT,
                  step=1, rows=rows)
    before = F.lag("balance").over(win)
    r, a, b = F.col("_t_r"), F.col("_t_a"), F.col("_t_b")
    cut = cut.withColumn("_t_r", F.when((rn > 1) & (before > 0), (F.col("balance") - before)
                                        / F.nullif(before, F.lit(0.0))).otherwise(0.0))
    cut = cut.withColumns({"_t_ma": decay_scan(r * w.eta, q, KEYS, AT, rows, back),
                           "_t_mb": decay_scan(r * r * w.eta, q, KEYS, AT, rows, back)})
    cut = cut.withColumns({"_t_a": F.coalesce(F.lag("_t_ma").over(win), F.lit(0.0)),
                           "_t_b": F.coalesce(F.lag("_t_mb").over(win), F.lit(0.0))})
    variance = b - a * a
    ratio = (b * (r - a) - 0.5 * a * (r * r - b)) / (F.pow(F.greatest(variance, F.lit(0.0)), F.lit(1.5)) + 1e-8)
    value = F.when((rn <= w.warmup + 1) | (variance < w.min_variance), 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio * w.scale)))
    out = own_rows(cut.withColumn(name, value))
    return out.drop(AT, *[c for c in out.columns if c.startswith("_t_")])


def apply_rewards(ledger: DataFrame, **rewards: Reward) -> DataFrame:
    """Several rewards side by side: each result's ``reward`` column under the given name."""
    out = ledger
    for name, reward in rewards.items():
        out = reward(out).withColumnRenamed("reward", name)
    return out


def reward_context(ledger: DataFrame, market: DataFrame, config, keys: Sequence[str] = (*SERIES, "ts")) -> DataFrame:
    """Ledger rows with margin per lot and the market state (ATR, RSI, regime) of their series and time, null if unknown."""
    keys = list(keys)
    state = market.select(*keys, *[c for c in ("atr_14", "rsi_14", "regime_state", "regime_confidence")
                                  if c in market.columns])
    bare = ledger.drop(*[c for c in state.columns if c not in keys])
    return bare.join(state, keys, "left").withColumn("margin_per_lot", config.margin_per_lot(F.col("close")))
