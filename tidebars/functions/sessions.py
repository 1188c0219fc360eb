"""Calendar and trading-session columns. All hours are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.schema import SESSIONS

# fixed values: bias and text per session, in order of priority
SESSION_BIAS = [
    ("london_open", 1.2, "London open — breakout expected"),
    ("overlap", 1.3, "London-NY overlap — peak liquidity"),
    ("late_ny", 0.3, "Late NY — declining liquidity"),
    ("asian", 0.7, "Asian session — consolidation expected"),
]
DEFAULT_BIAS = (1.0, "Normal trading hours")


def _col(ts: Column | str) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def hour_between(ts: Column | str, start: int, end: int) -> Column:
    """Hour of day in [start, end); a start after the end wraps midnight."""
    hour = F.hour(_col(ts))
    if start <= end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def in_session(ts: Column | str, name: str) -> Column:
    return hour_between(ts, *SESSIONS[name])


def is_month_turn(ts: Column | str) -> Column:
    """First two and last two days of a month."""
    ts = _col(ts)
    return (F.day(ts) <= 2) | (F.day(ts) >= F.day(F.last_day(ts)) - 1)


def time_columns(ts: Column | str = "ts") -> dict[str, Column]:
    ts = _col(ts)
    return {
        "is_london_session": in_session(ts, "london"),
        "is_ny_session": in_session(ts, "ny"),
        "is_overlap_session": in_session(ts, "overlap"),
        "is_asian_session": in_session(ts, "asian"),
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "is_month_turn": is_month_turn(ts),
    }


def with_time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(time_columns(ts))


def session_class(ts: Column | str) -> Column:
    """The one session a time belongs to: asian, london, overlap or ny."""
    hour = F.hour(_col(ts))
    return (
        F.when((hour >= 7) & (hour < 12), "london")
        .when((hour >= 12) & (hour < 16), "overlap")
        .when((hour >= 16) & (hour < 22), "ny")
        .otherwise("asian")
    )


def session_bias(ts: Column | str) -> Column:
    bias = F.lit(DEFAULT_BIAS[0])
    for name, value, _ in reversed(SESSION_BIAS):
        bias = F.when(in_session(ts, name), F.lit(value)).otherwise(bias)
    return bias


def session_text(ts: Column | str) -> Column:
    text = F.lit(DEFAULT_BIAS[1])
    for name, _, words in reversed(SESSION_BIAS):
        text = F.when(in_session(ts, name), F.lit(words)).otherwise(text)
    return text


def avoid_trading(ts: Column | str) -> Column:
    return in_session(ts, "late_ny")


def with_session_rules(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns({
        "session_class": session_class(ts),
        "session_bias": session_bias(ts),
        "session_reason": session_text(ts),
        "avoid_trading": avoid_trading(ts),
    })
