"""Building blocks of the comparison SQL. Written to be checked by eye, not to be fast."""

from __future__ import annotations

FIVE = "INTERVAL '5 minutes'"
HOUR = "INTERVAL '1 hour'"


def event_bars(name: str, width: str) -> str:
    return f"""{name} AS (
  SELECT event_type AS symbol, time_bucket({width}, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""


def order_bars(name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""


def numbered(name: str = "b", source: str = "bars", extra: str = "") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl{extra}
  FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {name}"


def rr(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def recursive(name: str, source: str, first_rn: int, seeds: dict[str, str], steps: dict[str, str],
              key: str = "symbol") -> str:
    """A row-by-row recurrence: seeds are scalars over the rows up to ``first_rn`` (aggregates over
    ``f``), steps see the previous state ``s`` and the current row ``x``."""
    seed = ", ".join(f"{e} AS {c}" for c, e in seeds.items())
    step = ", ".join(f"{e} AS {c}" for c, e in steps.items())
    return f"""{name} AS (
  SELECT f.{key}, CAST({first_rn} AS BIGINT) AS rn, {seed}
  FROM {source} f WHERE f.rn <= {first_rn} GROUP BY f.{key} HAVING max(f.rn) = {first_rn}
  UNION ALL
  SELECT x.{key}, x.rn, {step} FROM {name} s JOIN {source} x ON x.{key} = s.{key} AND x.rn = s.rn + 1)"""


def rsi(name: str, source: str, period: int, key: str = "symbol") -> str:
    up, down = "greatest({0}.close - {0}.pc, 0)", "greatest({0}.pc - {0}.close, 0)"
    n = period + 1
    return recursive(
        name, source, n,
        {"g": f"sum({up.format('f')}) FILTER (WHERE f.rn > 1) / {period}",
         "l": f"sum({down.format('f')}) FILTER (WHERE f.rn > 1) / {period}"},
        {"g": f"(s.g * {period - 1} + {up.format('x')}) / {period}",
         "l": f"(s.l * {period - 1} + {down.format('x')}) / {period}"},
        key,
    )


RSI_VALUE = "CASE WHEN {0}.l = 0 THEN 100.0 WHEN {0}.g IS NULL THEN NULL ELSE 100 - 100 / (1 + {0}.g / {0}.l) END"


def ema(name: str, source: str, x: str, period: int, first: int = 1) -> str:
    k = f"(2.0 / {period + 1})"
    return recursive(
        name, source, first + period - 1,
        {"y": f"avg(f.{x}) FILTER (WHERE f.rn >= {first})"},
        {"y": f"x.{x} * {k} + s.y * (1 - {k})"},
    )


TR = "CASE WHEN {0}.rn = 1 THEN {0}.high - {0}.low ELSE greatest({0}.high - {0}.low, abs({0}.high - {0}.pc), abs({0}.low - {0}.pc)) END"


def wilder(name: str, source: str, x: str, period: int = 14) -> str:
    return recursive(name, source, period, {"y": f"avg(f.{x})"},
                     {"y": f"(s.y * {period - 1} + x.{x}) / {period}"})


def macd_ctes(source: str = "b", fast: int = 12, slow: int = 26, signal: int = 9) -> str:
    return f"""{ema('ef', source, 'close', fast)}, {ema('es', source, 'close', slow)},
line AS (SELECT es.symbol, es.rn, ef.y - es.y AS close FROM es JOIN ef USING (symbol, rn)),
ln AS (SELECT symbol, rn - {slow - 1} AS rn, close FROM line), {ema('sig', 'ln', 'close', signal)}"""


VOL20 = """rt AS (
  SELECT *, CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS r1,
         CASE WHEN close > 0 AND p5 > 0 THEN ln(close / p5) END AS r5,
         CASE WHEN close > 0 AND p12 > 0 THEN ln(close / p12) END AS r12,
         CASE WHEN p48 > 0 THEN (close - p48) / p48 END AS m48 FROM b),
vr AS (
  SELECT symbol, ts, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(r1) OVER w END AS v
  FROM rt WHERE r1 IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
vol AS (
  SELECT rt.symbol, rt.ts, last_value(vr.v IGNORE NULLS) OVER (PARTITION BY rt.symbol ORDER BY rt.ts
         ROWS UNBOUNDED PRECEDING) AS v
  FROM rt LEFT JOIN vr ON vr.symbol = rt.symbol AND vr.ts = rt.ts)"""

LAGS = """, lag(close, 5) OVER w AS p5, lag(close, 12) OVER w AS p12, lag(close, 48) OVER w AS p48"""

BB = """bb AS (
  SELECT *, CASE WHEN rn >= 20 THEN avg(close) OVER w END AS mid, CASE WHEN rn >= 20 THEN stddev_pop(close) OVER w END AS sd
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
bb2 AS (SELECT *, mid + 2 * sd AS up, mid - 2 * sd AS low_band FROM bb)"""


def in_hours(ts: str, start: int, end: int) -> str:
    h = f"hour({ts})"
    return f"({h} >= {start} AND {h} < {end})" if start <= end else f"({h} >= {start} OR {h} < {end})"


def month_turn(ts: str) -> str:
    return f"(day({ts}) <= 2 OR day({ts}) >= day(last_day({ts})) - 1)"


# fixed values: the 24 model inputs in their order, written out again so that comparisons do not share our list
INPUTS = [
    "rsi_14", "rsi_7", "macd_line", "macd_signal", "macd_histogram", "bb_percent_b", "bb_width", "atr_14",
    "return_1bar", "return_5bar", "return_12bar", "rolling_volatility_20", "momentum_48",
    "is_london_session", "is_ny_session", "is_overlap_session", "is_asian_session",
    "hour_of_day", "day_of_week", "is_month_turn", "dxy_return_1h", "dxy_rsi_14", "vix_level", "vix_change",
]
