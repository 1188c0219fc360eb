"""Per-bar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.schema import FEATURE_COLUMNS, TIMEFRAME_MINUTES


def bar_shape(df: DataFrame) -> DataFrame:
    """mid_price, typical_price, range, body and is_bullish of every bar."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return df.withColumns({
        "mid_price": (h + l) / 2,
        "typical_price": (h + l + c) / 3,
        "range": h - l,
        "body": F.abs(c - o),
        "is_bullish": c > o,
    })


def align(ts: Column | str, seconds: Column | int) -> Column:
    """Start of the bar a time falls into. Every timeframe divides a day, so flooring the epoch works."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def feature_array(columns: list[str] | None = None) -> Column:
    """Model inputs in canonical order; booleans become 0/1 and nulls 0.0."""
    return F.array(*[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (columns or FEATURE_COLUMNS)
    ])


def parse_timeframe(label: Column) -> Column:
    """Canonical timeframe label, null if unknown."""
    clean = F.lower(F.trim(label))
    return F.when(clean.isin(*TIMEFRAME_MINUTES), clean)


def holding_period(bars: Column | str) -> Column:
    """Label of the shortest holding period that covers a number of 5-minute bars."""
    bars = F.col(bars) if isinstance(bars, str) else bars
    return F.when(bars <= 3, "15m").when(bars <= 6, "30m").when(bars <= 12, "1h").otherwise("2h")


def holding_period_bars(label: Column | str) -> Column:
    """5-minute bars of a holding-period label."""
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label == "15m", 3).when(label == "30m", 6).when(label == "1h", 12).when(label == "2h", 24)
