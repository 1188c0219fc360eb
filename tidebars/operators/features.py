"""The point-in-time feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.sessions import time_columns
from tidebars.operators import indicators as ind
from tidebars.operators.blocks import HALO, ROW, blocked, own_rows, run_stages
from tidebars.schema import FEATURES, SERIES, WARMUP_BARS


def warmup_complete() -> F.Column:
    return F.col(ROW) >= WARMUP_BARS


def compute_features(bars: DataFrame, cross: DataFrame | None = None, positive_prices: bool | None = None) -> DataFrame:
    """Every indicator, return, session flag and the warm-up mark for all series at once.

    ``cross`` holds the cross-asset columns per (symbol, timeframe, ts), see ``crossasset``; without
    it they are null. Where all closes are above zero every return exists, and volatility comes out of
    the same pass as the rest; otherwise it needs passes of its own. Say so in ``positive_prices``
    when it is known (bars that passed the price bounds); by default one scan of the closes finds out.
    """
    narrow = bars.select(*SERIES, "ts", "high", "low", "close")
    if positive_prices is None:
        lowest = narrow.agg(F.min("close")).first()[0]
        positive_prices = lowest is None or lowest > 0
    programs = [
        ind.rsi_stages(14, "rsi_14"), ind.rsi_stages(7, "rsi_7"), ind.macd_stages(), ind.bollinger_stages(),
        ind.atr_stages(), ind.return_stages(), ind.momentum_stages(),
        [{"warmup_complete": warmup_complete(), **time_columns("ts")}],
    ]
    if positive_prices:
        programs.append(ind.volatility_stages())
    table = own_rows(ind.settle(run_stages(blocked(narrow, back=HALO), *programs), ["rsi_14", "rsi_7"]))
    if not positive_prices:
        volatility = ind.rolling_volatility(narrow).select(*SERIES, "ts", "rolling_volatility_20")
        table = table.join(volatility, [*SERIES, "ts"], "left")
    if cross is not None:
        table = table.join(cross, [*SERIES, "ts"], "left")
    for name in ("dxy_return_1h", "dxy_rsi_14", "vix_level", "vix_change"):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast("double"))
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURES.fields])


def warm_only(features: DataFrame) -> DataFrame:
    return features.filter(F.col("warmup_complete"))
