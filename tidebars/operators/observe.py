"""Multi-timeframe observation vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.bars import feature_array
from tidebars.operators.asof import asof_join
from tidebars.operators.blocks import ROW, block_window, blocked, own_rows
from tidebars.schema import FEATURE_COLUMNS, SERIES, timeframe_minutes

# fixed values: order of the one-hot regime block
REGIME_STATES = ("low_vol_trend", "high_vol_trend", "ranging")
OHLCV = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class WindowSpec:
    """The last ``lookback`` bars of one timeframe."""

    timeframe: str
    lookback: int
    ohlcv: bool = False
    features: bool = True

    @property
    def columns(self) -> list[str]:
        return (list(OHLCV) if self.ohlcv else []) + (list(FEATURE_COLUMNS) if self.features else [])

    @property
    def size(self) -> int:
        return self.lookback * len(self.columns)


@dataclass(frozen=True)
class ObservationSpec:
    primary: str = "5m"
    windows: tuple[WindowSpec, ...] = (WindowSpec("5m", 20), WindowSpec("1h", 10), WindowSpec("4h", 5))
    regime: bool = True

    @property
    def size(self) -> int:
        return sum(w.size for w in self.windows) + (len(REGIME_STATES) + 1 if self.regime else 0)

    def layout(self) -> list[str]:
        """Name of the column behind every position of the vector."""
        names = [c for w in self.windows for _ in range(w.lookback) for c in w.columns]
        return names + (["regime"] * (len(REGIME_STATES) + 1) if self.regime else [])


def regime_block(state: Column, confidence: Column) -> Column:
    """One-hot state and confidence; zeros where there is no decision."""
    hot = [F.when(state == s, 1.0).otherwise(0.0) for s in REGIME_STATES]
    return F.array(*hot, F.when(state.isNotNull(), confidence).otherwise(0.0))


def trailing_windows(rows: DataFrame, spec: WindowSpec, name: str) -> DataFrame:
    """Per bar the values of the last ``lookback`` warm bars, oldest first; null where there are fewer.

    ``rows`` are features (with bar columns when ``ohlcv``) of any timeframes; only this one is used.
    """
    warm = rows.filter((F.col("timeframe") == spec.timeframe) & F.col("warmup_complete"))
    vectors = warm.select(*SERIES, "ts", feature_array(spec.columns).alias("_v"))
    frame = block_window().rowsBetween(-(spec.lookback - 1), 0)
    windowed = blocked(vectors, back=spec.lookback).withColumn(
        name, F.when(F.col(ROW) >= spec.lookback, F.flatten(F.collect_list("_v").over(frame))))
    return own_rows(windowed).select("symbol", "ts", name)


def observations(rows: DataFrame, spec: ObservationSpec = ObservationSpec(), regime: DataFrame | None = None,
                 start=None, end=None) -> DataFrame:
    """(symbol, ts, observation) for every warm primary bar that has all its windows.

    A bar of a higher timeframe counts once it is complete, never earlier. The windows are joined by
    the time of their newest bar: one as-of pass per higher timeframe.
    """
    primary = rows.filter((F.col("timeframe") == spec.primary) & F.col("warmup_complete")).select("symbol", "ts")
    if start is not None:
        primary = primary.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        primary = primary.filter(F.col("ts") <= F.lit(end))
    step = timeframe_minutes(spec.primary) * 60
    out, parts = primary, []
    for i, window in enumerate(spec.windows):
        name = f"_w{i}"
        trailing = trailing_windows(rows, window, name)
        if window.timeframe == spec.primary:
            out = out.join(trailing.filter(F.col(name).isNotNull()), ["symbol", "ts"])
        else:
            ready = F.col("ts") + F.make_interval(mins=F.lit(timeframe_minutes(window.timeframe)))
            out = asof_join(out, trailing, ["symbol"], step, available=ready, how="inner")
            out = out.filter(F.col(name).isNotNull()).drop("asof_ts")
        parts.append(F.col(name))
    if spec.regime:
        if regime is None:
            parts.append(F.array(*[F.lit(0.0)] * (len(REGIME_STATES) + 1)))
        else:
            decisions = regime.filter(F.col("timeframe") == spec.primary).select(
                "symbol", "ts", F.col("state").alias("_state"), F.col("confidence").alias("_conf"))
            out = out.join(decisions, ["symbol", "ts"], "left")
            parts.append(regime_block(F.col("_state"), F.col("_conf")))
    vector = F.concat(*parts)
    checked = F.when(F.size(vector) == spec.size, vector).otherwise(
        F.raise_error(F.lit("observation size mismatch")).cast("array<double>"))
    return out.select("symbol", "ts", checked.alias("observation"))
