"""Table schemas and the constants results depend on. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ("symbol", "timeframe")
TS = "ts"

# --- fixed values -----------------------------------------------------------------------
TIMEFRAME_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}

# (source, target) pairs that may be resampled, with source bars per complete target bar
RESAMPLE_RATIOS = {
    ("1m", "5m"): 5, ("1m", "15m"): 15, ("1m", "1h"): 60,
    ("5m", "15m"): 3, ("5m", "1h"): 12, ("5m", "4h"): 48,
    ("15m", "1h"): 4, ("15m", "4h"): 16,
    ("1h", "4h"): 4,
}

# UTC hours [start, end); a start after the end wraps midnight
SESSIONS = {
    "london": (7, 16),
    "ny": (12, 21),
    "overlap": (12, 16),
    "asian": (22, 7),
    "london_open": (7, 8),
    "late_ny": (17, 22),
}

WARMUP_BARS = 49

# canonical order of the model inputs
FEATURE_COLUMNS = [
    "rsi_14", "rsi_7", "macd_line", "macd_signal", "macd_histogram",
    "bb_percent_b", "bb_width", "atr_14",
    "return_1bar", "return_5bar", "return_12bar", "rolling_volatility_20", "momentum_48",
    "is_london_session", "is_ny_session", "is_overlap_session", "is_asian_session",
    "hour_of_day", "day_of_week", "is_month_turn",
    "dxy_return_1h", "dxy_rsi_14", "vix_level", "vix_change",
]

# symbol -> (pip size, min price, max price); symbols not listed here skip the bounds rule
SYMBOL_SPECS = {
    "XAUUSD": ("0.01", 1000.0, 10000.0),
    "DXY": ("0.001", 50.0, 150.0),
    "VIX": ("0.01", 5.0, 100.0),
}

# symbol -> (exchange, security type, currency, timeframes, tradeable)
SYMBOLS = {
    "XAUUSD": ("SMART", "CFD", "USD", ("5m", "15m", "1h", "4h"), True),
    "DXY": ("NYBOT", "IND", "USD", ("5m", "1h"), False),
    "DXY_FUT": ("NYBOT", "CONTFUT", "USD", ("5m", "1h"), False),
    "VIX": ("CBOE", "IND", "USD", ("5m", "1h"), False),
    "VIX_FUT": ("CFE", "CONTFUT", "USD", ("5m", "1h"), False),
    "EURUSD": ("IDEALPRO", "CASH", "USD", ("5m", "15m", "1h", "4h"), True),
    "GBPUSD": ("IDEALPRO", "CASH", "USD", ("5m", "15m", "1h", "4h"), True),
    "USDJPY": ("IDEALPRO", "CASH", "JPY", ("5m",), False),
    "USDCAD": ("IDEALPRO", "CASH", "CAD", ("5m",), False),
    "USDSEK": ("IDEALPRO", "CASH", "SEK", ("5m",), False),
    "USDCHF": ("IDEALPRO", "CASH", "CHF", ("5m",), False),
    "DXY_SYNTH": ("", "SYNTH", "USD", ("5m", "15m", "1h", "4h"), False),
}

# six-currency dollar index: constant and exponents
DOLLAR_INDEX_CONSTANT = 50.14348112
DOLLAR_INDEX_WEIGHTS = {
    "EURUSD": -0.576, "USDJPY": 0.136, "GBPUSD": -0.119,
    "USDCAD": 0.091, "USDSEK": 0.042, "USDCHF": 0.036,
}
# --- end of fixed values ----------------------------------------------------------------


def _fields(pairs: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_S, _D, _B, _I, _L, _TS = (
    T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.TimestampType(),
)
_PRICES = ["open", "high", "low", "close"]

RAW_BARS = _fields([("ts", _TS)] + [(c, _S) for c in _PRICES + ["volume", "symbol", "timeframe"]])

BARS = _fields(
    [("symbol", _S), ("timeframe", _S), ("ts", _TS)]
    + [(c, _D) for c in _PRICES + ["volume"]]
    + [("is_complete", _B)]
)

_FEATURE_TYPES = {
    **{c: _B for c in FEATURE_COLUMNS if c.startswith("is_")},
    "hour_of_day": _I,
    "day_of_week": _I,
}
FEATURES = _fields(
    [("symbol", _S), ("timeframe", _S), ("ts", _TS)]
    + [(c, _FEATURE_TYPES.get(c, _D)) for c in [
        "rsi_14", "rsi_7", "macd_line", "macd_signal", "macd_histogram",
        "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_percent_b", "atr_14",
        "return_1bar", "return_5bar", "return_12bar", "rolling_volatility_20", "momentum_48",
        "is_london_session", "is_ny_session", "is_overlap_session", "is_asian_session",
        "hour_of_day", "day_of_week", "is_month_turn", "dxy_return_1h", "dxy_rsi_14", "vix_level", "vix_change",
    ]]
    + [("warmup_complete", _B)]
)

DECISIONS = _fields([
    ("episode_id", _L), ("step", _I), ("ts", _TS), ("action", _I), ("close", _D),
    ("atr_14", _D), ("rsi_14", _D), ("regime_state", _S),
])

REGIME = _fields([
    ("symbol", _S), ("timeframe", _S), ("ts", _TS), ("state", _S), ("confidence", _D),
    ("position_multiplier", _D), ("should_trade", _B), ("reason", _S), ("hmm_prob", _D),
    ("adx_value", _D), ("atr_expanding", _B), ("session_bias", _D),
])

SIGNALS = _fields([
    ("symbol", _S), ("timeframe", _S), ("ts", _TS), ("direction", _S), ("confidence", _D),
    ("predicted_horizon", _S), ("base_prob", _D), ("sequence_prob", _D), ("ensemble_prob", _D),
    ("top_features", T.MapType(_S, _D)), ("warmup_complete", _B),
])


def timeframe_minutes(timeframe: str) -> int:
    """Minutes of a timeframe label; accepts any case and surrounding blanks."""
    label = timeframe.strip().lower()
    if label not in TIMEFRAME_MINUTES:
        raise ValueError(f"unknown timeframe {timeframe!r}; known: {', '.join(TIMEFRAME_MINUTES)}")
    return TIMEFRAME_MINUTES[label]


def timeframe_seconds(column: Column | str = "timeframe") -> Column:
    """Seconds per bar of a timeframe column (null for unknown labels)."""
    column = F.col(column) if isinstance(column, str) else column
    pairs = [F.lit(v) for label, m in TIMEFRAME_MINUTES.items() for v in (label, m * 60)]
    return F.try_element_at(F.create_map(*pairs), column).cast("long")
