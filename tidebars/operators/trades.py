"""Replaying signals into trades, one position at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.automaton import run_automaton
from tidebars.operators.blocks import block_window, blocked, own_rows
from tidebars.schema import SERIES

# fixed values: bars a position is held
HORIZON_5M, HORIZON_OTHER = 12, 6


def default_horizon(timeframe: str) -> int:
    return HORIZON_5M if timeframe == "5m" else HORIZON_OTHER


def holding_table(horizon: int) -> list[list[int]]:
    """Machine over bars left to hold: code 1 (a signal) opens a position when flat at the bar's close."""
    idle = [max(left - 1, 0) for left in range(horizon + 1)]
    return [idle, [horizon if left == 0 else left for left in idle]]


def signal_rule(probability_long: Column, probability_short: Column, threshold: float = 0.55) -> tuple[Column, Column]:
    """(direction, confidence): neutral unless the stronger side is above the threshold."""
    best = F.greatest(probability_long, probability_short)
    side = F.when(probability_long > probability_short, "long").otherwise("short")
    return F.when(best <= threshold, "neutral").otherwise(side), F.when(best <= threshold, 0.0).otherwise(best)


def priced_ahead(bars: DataFrame, horizon: int, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Bars with what a position opened after them would enter and leave at, and how long it would last."""
    ahead, nxt = block_window(keys).rowsBetween(0, horizon), block_window(keys)
    return own_rows(blocked(bars, fwd=horizon, keys=keys, rows=block_rows).withColumns({
        "_entry": F.lead("open").over(nxt), "_entry_ts": F.lead("ts").over(nxt),
        "_exit": F.last("close").over(ahead), "_exit_ts": F.last("ts").over(ahead),
        "_held": (F.count(F.lit(1)).over(ahead) - 1).cast("int")}))


def trade_rows(opened: DataFrame, horizon: int, spread: float, direction: str, regime: str | None, keys: Sequence[str]) -> DataFrame:
    """Trades of the bars of ``priced_ahead`` after which a position is opened."""
    entry, leave = F.col("_entry"), F.col("_exit")
    cost = F.lit(float(spread)) / F.nullif(entry, F.lit(0.0))
    gain = F.when(F.col(direction) == "long", (leave - entry) / F.nullif(entry, F.lit(0.0))).otherwise(
        (entry - leave) / F.nullif(entry, F.lit(0.0)))
    return opened.select(
        *keys, F.col("ts").alias("signal_ts"), F.col(direction).alias("direction"),
        F.col("_entry_ts").alias("entry_ts"), entry.alias("entry_price"),
        F.col("_exit_ts").alias("exit_ts"), leave.alias("exit_price"), cost.alias("spread_pct"),
        F.lit(horizon).alias("horizon"), F.col("_held").alias("bars_held"), ((gain - cost) * 100).alias("pnl_pct"),
        (F.col(regime) if regime else F.lit(None).cast("string")).alias("regime_state"))


def replay(
    bars: DataFrame,
    horizon: int,
    spread: float = 0.0,
    direction: str = "direction",
    eligible: Column | None = None,
    regime: str | None = None,
    keys: Sequence[str] = SERIES,
    block_rows: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """(trades, checked bars) for bars that carry a signal.

    A signal at bar t on an eligible bar, with no position open, enters at the open of t+1 and leaves
    at the close of t+horizon (or of the last bar). The bar of an exit may signal again. Checked bars
    are those eligible ones at which no position was open.
    """
    keys = list(keys)
    eligible = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    active = F.col(direction).isin("long", "short") & F.col("_ok") & (F.col("_entry") > 0)
    coded = priced_ahead(bars.withColumn("_ok", eligible), horizon, keys, block_rows).withColumn(
        "_code", F.coalesce(active.cast("int"), F.lit(0)))
    run = run_automaton(coded, "_code", holding_table(horizon), keys, name="_left", rows=block_rows)
    flat = F.greatest(F.col("_left") - 1, F.lit(0)) == 0
    trades = trade_rows(run.filter(flat & (F.col("_code") == 1)), horizon, spread, direction, regime, keys)
    return trades, run.filter(flat & F.col("_ok")).select(*keys, "ts")


def replay_grid(bars: DataFrame, horizons: Sequence[int], spreads: Sequence[float], **options) -> DataFrame:
    """Trades for every combination. The choice of trades does not depend on the spread."""
    grid = F.explode(F.array(*[F.lit(float(s)) for s in spreads]))
    out = None
    for horizon in horizons:
        trades, _ = replay(bars, horizon, 0.0, **options)
        part = trades.withColumn("spread", grid).withColumns({
            "spread_pct": F.col("spread") / F.col("entry_price"),
            "pnl_pct": F.col("pnl_pct") - 100 * F.col("spread") / F.col("entry_price")})
        out = part if out is None else out.unionByName(part)
    return out
