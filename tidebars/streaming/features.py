"""Features and regimes per arriving bar, with one small state per series.

The state holds the smoothed averages and the last few closes, so a bar costs the same however long
the series is. Values agree with the batch operators. Bars at or before the newest one seen are
skipped: the batch operators are the way to rebuild a series that was repaired.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebars.functions.sessions import time_columns
from tidebars.operators.changepoint import MIN_SIZE, RECENT, WINDOW, segment
from tidebars.operators.regime import (
    ATR_EXPANSION, HIGH, LOW, PERSISTENCE_BARS, RANGE_ADX, RANGING, STATES, TREND_ADX, decide, persistence_table,
)
from tidebars.schema import FEATURES, SERIES, WARMUP_BARS

NUMBERS = [
    "rsi_14", "rsi_7", "macd_line", "macd_signal", "macd_histogram", "bb_upper", "bb_middle", "bb_lower", "bb_width",
    "bb_percent_b", "atr_14", "return_1bar", "return_5bar", "return_12bar", "rolling_volatility_20", "momentum_48",
]


@dataclass
class Average:
    """Running average that starts as the mean of its first ``n`` values and then moves by ``gain``."""

    n: int
    gain: float
    count: int = 0
    value: float = 0.0

    def add(self, x: float) -> float | None:
        self.count += 1
        self.value += (x - self.value) * (1 / self.count if self.count <= self.n else self.gain)
        return self.value if self.count >= self.n else None


def _wilder(n: int = 14) -> Average:
    return Average(n, 1 / n)


def _ema(n: int) -> Average:
    return Average(n, 2 / (n + 1))


@dataclass
class FeatureState:
    rows: int = 0
    closes: list[float] = field(default_factory=list)
    returns: list[float] = field(default_factory=list)
    averages: dict[str, Average] = field(default_factory=lambda: {
        "g14": _wilder(14), "l14": _wilder(14), "g7": _wilder(7), "l7": _wilder(7), "fast": _ema(12), "slow": _ema(26),
        "signal": _ema(9), "atr": _wilder(14)})

    def rsi(self, change: float, n: int) -> float | None:
        up, down = self.averages[f"g{n}"].add(max(change, 0.0)), self.averages[f"l{n}"].add(max(-change, 0.0))
        if up is None:
            return None
        return 100.0 if down == 0 else 100.0 - 100.0 / (1.0 + up / down)

    def log_return(self, bars: int) -> float | None:
        if len(self.closes) <= bars or self.closes[-1] <= 0 or self.closes[-1 - bars] <= 0:
            return None
        return math.log(self.closes[-1] / self.closes[-1 - bars])

    def add(self, bar) -> dict:
        previous = self.closes[-1] if self.closes else None
        self.rows += 1
        self.closes = (self.closes + [bar.close])[-WARMUP_BARS:]
        out: dict = dict.fromkeys(NUMBERS)
        if previous is not None:
            out["rsi_14"], out["rsi_7"] = (self.rsi(bar.close - previous, n) for n in (14, 7))
        a = self.averages
        fast, slow = a["fast"].add(bar.close), a["slow"].add(bar.close)
        if slow is not None:
            out["macd_line"] = fast - slow
            out["macd_signal"] = a["signal"].add(out["macd_line"])
            if out["macd_signal"] is not None:
                out["macd_histogram"] = out["macd_line"] - out["macd_signal"]
        if self.rows >= 20:
            last = np.asarray(self.closes[-20:])
            mid, spread = float(last.mean()), 2.0 * float((last - last[0]).std())
            out.update(bb_middle=mid, bb_upper=mid + spread, bb_lower=mid - spread)
            band = out["bb_upper"] - out["bb_lower"]
            out["bb_width"] = 0.0 if mid == 0 else band / mid
            out["bb_percent_b"] = 0.5 if band == 0 else (bar.close - out["bb_lower"]) / band
        reach = [bar.high - bar.low] + ([] if previous is None else [abs(bar.high - previous), abs(bar.low - previous)])
        out["atr_14"] = a["atr"].add(max(reach))
        for bars in (1, 5, 12):
            out[f"return_{bars}bar"] = self.log_return(bars)
        if out["return_1bar"] is not None:
            self.returns = (self.returns + [out["return_1bar"]])[-20:]
        if len(self.returns) == 20:
            out["rolling_volatility_20"] = float(np.std(self.returns))
        if len(self.closes) == WARMUP_BARS and self.closes[0] > 0:
            out["momentum_48"] = (bar.close - self.closes[0]) / self.closes[0]
        out["warmup_complete"] = self.rows >= WARMUP_BARS
        return out


@dataclass
class RegimeMemory:
    closes: list[float] = field(default_factory=list)
    prices: list[float] = field(default_factory=list)
    returns: list[float] = field(default_factory=list)
    atr: float | None = None
    held: str = RANGING
    machine: int = STATES.index(RANGING) * PERSISTENCE_BARS
    averages: dict[str, Average] = field(default_factory=lambda: {k: _wilder(14) for k in ("tr", "up", "down", "dx")})

    def strength(self, bar) -> float | None:
        """ADX; the first bar enters the averages as zero, which is what makes them thirteen over fourteen."""
        tr = up = down = 0.0
        first = not self.prices
        if not first:
            high, low, close = self.prices
            rise, fall = bar.high - high, low - bar.low
            up, down = (rise if rise > fall and rise > 0 else 0.0), (fall if fall > rise and fall > 0 else 0.0)
            tr = max(bar.high - bar.low, abs(bar.high - close), abs(bar.low - close))
        self.prices = [bar.high, bar.low, bar.close]
        a = self.averages
        tr, up, down = a["tr"].add(tr), a["up"].add(up), a["down"].add(down)
        if a["tr"].count <= 14 or not tr:
            return None
        both = up + down
        return a["dx"].add(0.0 if both == 0 else 100.0 * abs(up - down) / both)

    def changed(self, bar) -> bool:
        if self.closes and self.closes[0] > 0:
            self.returns = (self.returns + [(bar.close - self.closes[0]) / self.closes[0]])[-WINDOW:]
        self.closes = [bar.close]
        n = len(self.returns)
        return n >= 2 * MIN_SIZE and any(p > n - RECENT for p in segment(np.asarray([self.returns]))[0])

    def add(self, bar) -> dict:
        adx, changed = self.strength(bar), self.changed(bar)
        atr = None if bar.atr_14 is None or math.isnan(bar.atr_14) else bar.atr_14
        expanding = bool(atr is not None and self.atr is not None and self.atr > 0 and atr / self.atr >= ATR_EXPANSION)
        if atr is not None:
            self.atr = atr
        conf = 0.5
        if adx is not None:
            if expanding:
                self.held, conf = HIGH, min(adx / 50.0, 1.0)
            elif adx < RANGE_ADX:
                self.held, conf = RANGING, max(0.5, min(1.0 - adx / RANGE_ADX, 1.0))
            elif adx > TREND_ADX:
                self.held, conf = LOW, max(0.5, min(adx / 50.0, 1.0))
        proposed, vote = self.held, conf * (0.9 if changed else 1.0)
        if isinstance(bar.hmm_state, str) and not math.isnan(bar.hmm_prob):
            scores = {s: 0.6 * conf * (s == self.held) + 0.3 * bar.hmm_prob * (s == bar.hmm_state)
                      + 0.1 * (changed and s == HIGH) for s in STATES}
            proposed = max(scores, key=scores.get)
            total = sum(scores.values())
            vote = scores[proposed] / total if total > 0 else scores[proposed]
        self.machine = _PERSISTENCE[STATES.index(proposed)][self.machine]
        return {"adx_value": adx, "atr_expanding": expanding, "intraday_state": self.held, "intraday_conf": conf,
                "recent_change": changed, "proposed_state": proposed, "vote_conf": vote,
                "state": STATES[self.machine // PERSISTENCE_BARS]}


_PERSISTENCE = persistence_table(PERSISTENCE_BARS)


def _pack(memory, last: pd.Timestamp) -> str:
    body = {k: ({n: [a.count, a.value] for n, a in v.items()} if k == "averages" else v) for k, v in vars(memory).items()}
    return json.dumps({"last": last.value, "body": body})


def _unpack(memory, text: str):
    stored = json.loads(text)
    for name, value in stored["body"].items():
        if name == "averages":
            for key, (count, number) in value.items():
                memory.averages[key].count, memory.averages[key].value = count, number
        else:
            setattr(memory, name, value)
    return memory, pd.Timestamp(stored["last"])


def _stateful(rows: DataFrame, make: Callable, outputs: list[str], out_schema: str, keep: list[str]) -> DataFrame:
    """Run ``make().add(row)`` over every series in time order; output ``keep`` columns and results."""

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, last = make(), None
        if state.exists:
            memory, last = _unpack(memory, state.get[0])
        out = []
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            if last is not None and row.ts <= last:
                continue
            last = row.ts
            result = memory.add(row)
            out.append([getattr(row, c) for c in keep] + [result[c] for c in outputs])
        if last is not None:
            state.update((_pack(memory, last),))
        frame = pd.DataFrame(out, columns=keep + outputs)
        yield frame.astype({c: "float64" for c in outputs if c in _FLOATS})

    return rows.groupBy(*SERIES).applyInPandasWithState(
        follow, out_schema, "packed string", "append", GroupStateTimeout.NoTimeout)


_FLOATS = {*NUMBERS, "adx_value", "intraday_conf", "vote_conf"}


def features_stream(bars: DataFrame) -> DataFrame:
    """FEATURES rows of a bar stream (cross-asset columns null)."""
    keys = "symbol string, timeframe string, ts timestamp, "
    schema = keys + ", ".join(f"{c} double" for c in NUMBERS) + ", warmup_complete boolean"
    raw = _stateful(bars.select(*SERIES, "ts", "high", "low", "close"), FeatureState, [*NUMBERS, "warmup_complete"],
                    schema, [*SERIES, "ts"])
    numbers = raw.withColumns({**{c: F.nanvl(c, F.lit(None).cast("double")) for c in NUMBERS}, **time_columns("ts")})
    have = set(numbers.columns)
    return numbers.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in FEATURES.fields])


def regime_stream(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Regime decisions of a stream with high, low, close and atr_14; hmm_state and hmm_prob are optional.

    ``keep`` names further columns to carry along (text columns).
    """
    for name, kind in (("hmm_state", "string"), ("hmm_prob", "double")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    keep = keep or []
    outputs = ["adx_value", "atr_expanding", "intraday_state", "intraday_conf", "recent_change", "proposed_state",
               "vote_conf", "state"]
    types = ["double", "boolean", "string", "double", "boolean", "string", "double", "string"]
    schema = ", ".join(["symbol string", "timeframe string", "ts timestamp", "hmm_prob double",
                        *[f"{c} string" for c in keep], *[f"{c} {t}" for c, t in zip(outputs, types)]])
    raw = _stateful(rows.select(*SERIES, "ts", "high", "low", "close", "atr_14", "hmm_state", "hmm_prob", *keep),
                    RegimeMemory, outputs, schema, [*SERIES, "ts", "hmm_prob", *keep])
    return decide(raw.withColumn("adx_value", F.nanvl("adx_value", F.lit(None).cast("double"))))


def proxy_bars(features: DataFrame) -> DataFrame:
    """Bars rebuilt from features where only those travel: the band's middle as price, one ATR around it."""
    price, reach = F.coalesce("bb_middle", F.lit(0.0)), F.coalesce("atr_14", F.lit(0.0))
    return features.withColumns({
        "close": price, "high": price + reach, "low": F.when(price > reach, price - reach).otherwise(0.01)})
