"""Comparison SQL of ``series_queries``."""

from __future__ import annotations

from tidebars.plans import sql_parts as p

B5, B1 = p.event_bars("bars", p.FIVE), p.event_bars("bars", p.HOUR)
BAR = "symbol, '{tf}' AS timeframe, ts, open, high, low, close, volume"
RSI14 = p.RSI_VALUE.format("s")


def _coarse(source: str, width: str, need: int, label: str) -> str:
    return f"""SELECT symbol, '{label}' AS timeframe, time_bucket({width}, ts) AS ts, arg_min(open, ts) AS open,
  max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) = {need} AS is_complete
  FROM {source} GROUP BY symbol, time_bucket({width}, ts)"""


_MANY = f"""SELECT symbol, '5m' AS timeframe, ts, open, high, low, close, volume, TRUE AS is_complete FROM bars
UNION ALL {_coarse('bars', "INTERVAL '15 minutes'", 3, '15m')} UNION ALL {_coarse('bars', p.HOUR, 12, '1h')}"""

_ADX = f"""{p.numbered()},
d AS (SELECT *, {p.TR.format('b')} AS tr0, high - ph AS u, pl - low AS dn FROM b),
m AS (SELECT symbol, ts, rn, CASE WHEN rn > 1 THEN tr0 ELSE 0 END AS tr,
        CASE WHEN u > dn AND u > 0 THEN u ELSE 0 END AS pd, CASE WHEN dn > u AND dn > 0 THEN dn ELSE 0 END AS md FROM d),
{p.recursive('sm', 'm', 14,
             {c: f'sum(f.{c}) / 14' for c in ('tr', 'pd', 'md')},
             {c: f'(s.{c} * 13 + x.{c}) / 14' for c in ('tr', 'pd', 'md')})},
dx AS (SELECT symbol, rn, CASE WHEN pd + md = 0 THEN 0 ELSE 100 * abs(pd - md) / (pd + md) END AS dx
       FROM sm WHERE rn > 14 AND tr <> 0),
dn AS (SELECT symbol, rn AS bar, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS rn, dx FROM dx),
{p.wilder('ax', 'dn', 'dx')},
adx AS (SELECT dn.symbol, dn.bar AS rn, ax.y FROM ax JOIN dn USING (symbol, rn))"""

_FEATURES = f"""{B1}, {p.numbered(extra=p.LAGS)}, {p.rsi('s', 'b', 14)}, {p.rsi('s7', 'b', 7)}, {p.macd_ctes()},
{p.BB}, {p.VOL20}, t AS (SELECT *, {p.TR.format('b')} AS tr FROM b), {p.wilder('atr', 't', 'tr')}
SELECT b.symbol, '1h' AS timeframe, b.ts, {p.r(RSI14, 'rsi_14')}, {p.r(p.RSI_VALUE.format('s7'), 'rsi_7')},
  {p.r('line.close', 'macd_line')}, {p.r('sig.y', 'macd_signal')}, {p.r('line.close - sig.y', 'macd_histogram')},
  {p.r('bb2.up', 'bb_upper')}, {p.r('bb2.mid', 'bb_middle')}, {p.r('bb2.low_band', 'bb_lower')},
  {p.r('CASE WHEN bb2.mid = 0 THEN 0 ELSE (bb2.up - bb2.low_band) / bb2.mid END', 'bb_width')},
  {p.r('CASE WHEN bb2.up = bb2.low_band THEN 0.5 ELSE (bb2.close - bb2.low_band) / (bb2.up - bb2.low_band) END', 'bb_percent_b')},
  {p.r('atr.y', 'atr_14')}, {p.r('rt.r1', 'return_1bar')}, {p.r('rt.r5', 'return_5bar')},
  {p.r('rt.r12', 'return_12bar')}, {p.r('vol.v', 'rolling_volatility_20')}, {p.r('rt.m48', 'momentum_48')},
  {p.in_hours('b.ts', 7, 16)} AS is_london_session, {p.in_hours('b.ts', 12, 21)} AS is_ny_session,
  {p.in_hours('b.ts', 12, 16)} AS is_overlap_session, {p.in_hours('b.ts', 22, 7)} AS is_asian_session,
  CAST(hour(b.ts) AS INTEGER) AS hour_of_day, CAST(isodow(b.ts) - 1 AS INTEGER) AS day_of_week,
  {p.month_turn('b.ts')} AS is_month_turn, b.rn >= 49 AS warmup_complete,
  CAST(NULL AS DOUBLE) AS dxy_return_1h, CAST(NULL AS DOUBLE) AS dxy_rsi_14,
  CAST(NULL AS DOUBLE) AS vix_level, CAST(NULL AS DOUBLE) AS vix_change
FROM b LEFT JOIN s USING (symbol, rn) LEFT JOIN s7 USING (symbol, rn) LEFT JOIN line USING (symbol, rn)
  LEFT JOIN (SELECT symbol, rn + 25 AS rn, y FROM sig) sig USING (symbol, rn) LEFT JOIN bb2 USING (symbol, rn)
  LEFT JOIN atr USING (symbol, rn) LEFT JOIN rt USING (symbol, rn)
  LEFT JOIN vol ON vol.symbol = b.symbol AND vol.ts = b.ts"""

SQL = {
    "bars_1h": f"WITH {B1} SELECT {BAR.format(tf='1h')} FROM bars",
    "bars_5m": f"WITH {B5} SELECT {BAR.format(tf='5m')} FROM bars",
    "resample_4h": f"""WITH {B1} {_coarse('bars', "INTERVAL '4 hours'", 4, '4h')}""",
    "multi_timeframe": f"""WITH {B5} {_MANY} UNION ALL {_coarse('bars', "INTERVAL '4 hours'", 48, '4h')}""",
    "daily_sample": f"""WITH {B5} SELECT symbol, '1d' AS timeframe, date_trunc('day', ts)::TIMESTAMP AS ts,
  arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
  FROM bars GROUP BY symbol, date_trunc('day', ts)""",
    "daily_sample_mixed": f"""WITH {B5}, many AS ({_MANY}),
k AS (SELECT *, epoch(ts) * 100 + CASE timeframe WHEN '1h' THEN 1 WHEN '5m' THEN 2 ELSE 3 END AS o FROM many)
SELECT symbol, '1d' AS timeframe, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(open, o) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, o) AS close, sum(volume) AS volume FROM k GROUP BY symbol, date_trunc('day', ts)""",
    "daily_bars": f"WITH {p.order_bars()} SELECT {BAR.format(tf='1d')} FROM bars",
    "bar_shapes": f"""WITH {B5} SELECT symbol, ts, {p.r('(high + low) / 2', 'mid_price')},
  {p.r('(high + low + close) / 3', 'typical_price')}, {p.r('high - low', 'range')}, {p.r('abs(close - open)', 'body')},
  close > open AS is_bullish FROM bars""",
    "rsi_14": f"""WITH RECURSIVE {B1}, {p.numbered()}, {p.rsi('s', 'b', 14)}
SELECT b.symbol, b.ts, {p.r(RSI14, 'rsi_14')} FROM b LEFT JOIN s USING (symbol, rn)""",
    "rsi_7": f"""WITH RECURSIVE {B1}, {p.numbered()}, {p.rsi('s', 'b', 7)}
SELECT b.symbol, b.ts, {p.r(RSI14, 'rsi_7')} FROM b LEFT JOIN s USING (symbol, rn)""",
    **{f"rsi_{n}": f"""WITH RECURSIVE {B5}, {p.numbered()}, {p.rsi('s', 'b', n)}
SELECT b.symbol, b.ts, {p.r(p.RSI_VALUE.format('s'), f'rsi_{n}')} FROM b LEFT JOIN s USING (symbol, rn)""" for n in (2, 200)},
    "atr_5": f"""WITH RECURSIVE {B5}, {p.numbered()}, t AS (SELECT *, {p.TR.format('b')} AS tr FROM b),
{p.wilder('a', 't', 'tr', 5)} SELECT b.symbol, b.ts, {p.r('a.y', 'atr_5')} FROM b LEFT JOIN a USING (symbol, rn)""",
    "macd_5_35_5": f"""WITH RECURSIVE {B5}, {p.numbered()}, {p.macd_ctes('b', 5, 35, 5)}
SELECT b.symbol, b.ts, {p.r('line.close', 'macd_line')}, {p.r('sig.y', 'macd_signal')},
  {p.r('line.close - sig.y', 'macd_histogram')}
FROM b LEFT JOIN line USING (symbol, rn) LEFT JOIN sig ON sig.symbol = b.symbol AND sig.rn = b.rn - 34""",
    "macd": f"""WITH RECURSIVE {B1}, {p.numbered()}, {p.macd_ctes()}
SELECT b.symbol, b.ts, {p.r('line.close', 'macd_line')}, {p.r('sig.y', 'macd_signal')},
  {p.r('line.close - sig.y', 'macd_histogram')}
FROM b LEFT JOIN line USING (symbol, rn) LEFT JOIN sig ON sig.symbol = b.symbol AND sig.rn = b.rn - 25""",
    "atr_14": f"""WITH RECURSIVE {B1}, {p.numbered()}, t AS (SELECT *, {p.TR.format('b')} AS tr FROM b),
{p.wilder('a', 't', 'tr')} SELECT b.symbol, b.ts, {p.r('a.y', 'atr_14')} FROM b LEFT JOIN a USING (symbol, rn)""",
    "adx_14": f"""WITH RECURSIVE {B1}, {_ADX}
SELECT b.symbol, b.ts, {p.r('adx.y', 'adx_14')} FROM b LEFT JOIN adx USING (symbol, rn)""",
    "bollinger": f"""WITH {B5}, {p.numbered()}, {p.BB}
SELECT symbol, ts, {p.r('up', 'bb_upper')}, {p.r('mid', 'bb_middle')}, {p.r('low_band', 'bb_lower')},
  {p.r('CASE WHEN mid = 0 THEN 0 ELSE (up - low_band) / mid END', 'bb_width')},
  {p.r('CASE WHEN up = low_band THEN 0.5 ELSE (close - low_band) / (up - low_band) END', 'bb_percent_b')} FROM bb2""",
    "log_returns": f"""WITH {B5}, {p.numbered(extra=p.LAGS)}, {p.VOL20}
SELECT symbol, ts, {p.r('r1', 'return_1bar')}, {p.r('r5', 'return_5bar')}, {p.r('r12', 'return_12bar')} FROM rt""",
    "rolling_vol": f"""WITH {B5}, {p.numbered(extra=p.LAGS)}, {p.VOL20}
SELECT symbol, ts, {p.r('v', 'rolling_volatility_20')} FROM vol""",
    "momentum": f"""WITH {B5}, {p.numbered(extra=p.LAGS)}, {p.VOL20}
SELECT symbol, ts, {p.r('m48', 'momentum_48', 8)} FROM rt""",
    "atr_mean": f"""WITH {B5}, {p.numbered()}, t AS (SELECT *, {p.TR.format('b')} AS tr FROM b)
SELECT symbol, ts, CASE WHEN rn >= 14 THEN {p.r('avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)', 'x')[:-5]}
  END AS atr_mean FROM t""",
    "feature_table": f"WITH RECURSIVE {_FEATURES}",
    "session_flags": f"""SELECT event_type AS symbol, ts, {p.in_hours('ts', 7, 16)} AS is_london_session,
  {p.in_hours('ts', 12, 21)} AS is_ny_session, {p.in_hours('ts', 12, 16)} AS is_overlap_session,
  {p.in_hours('ts', 22, 7)} AS is_asian_session, {p.in_hours('ts', 23, 2)} AS around_midnight,
  hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
  CASE WHEN hour(ts) BETWEEN 7 AND 11 THEN 'london' WHEN hour(ts) BETWEEN 12 AND 15 THEN 'overlap'
       WHEN hour(ts) BETWEEN 16 AND 21 THEN 'ny' ELSE 'asian' END AS session_class,
  CAST(CASE WHEN hour(ts) = 7 THEN 1.2 WHEN hour(ts) BETWEEN 12 AND 15 THEN 1.3 WHEN hour(ts) BETWEEN 17 AND 21 THEN 0.3
       WHEN hour(ts) >= 22 OR hour(ts) < 7 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS session_bias,
  CASE WHEN hour(ts) = 7 THEN 'London open — breakout expected'
       WHEN hour(ts) BETWEEN 12 AND 15 THEN 'London-NY overlap — peak liquidity'
       WHEN hour(ts) BETWEEN 17 AND 21 THEN 'Late NY — declining liquidity'
       WHEN hour(ts) >= 22 OR hour(ts) < 7 THEN 'Asian session — consolidation expected'
       ELSE 'Normal trading hours' END AS session_reason,
  hour(ts) BETWEEN 17 AND 21 AS avoid_trading FROM events""",
    "month_turn": f"""WITH {p.order_bars()} SELECT symbol, {p.month_turn('ts')} AS is_month_turn, count(*) AS days,
  min(ts) AS first_day, max(ts) AS last_day FROM bars GROUP BY 1, 2""",
    "holding_periods": f"""WITH {B1}, g AS (SELECT CAST(volume AS BIGINT) AS bars, count(*) AS n FROM bars GROUP BY 1)
SELECT bars, n, CASE WHEN bars <= 3 THEN '15m' WHEN bars <= 6 THEN '30m' WHEN bars <= 12 THEN '1h' ELSE '2h' END AS horizon,
  CAST(CASE WHEN bars <= 3 THEN 3 WHEN bars <= 6 THEN 6 WHEN bars <= 12 THEN 12 ELSE 24 END AS BIGINT) AS horizon_bars FROM g""",
    "weekend_gaps": f"""WITH {p.order_bars()}, n AS (
  SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM bars WHERE isodow(ts) < 6)
SELECT symbol, ts FROM n WHERE isodow(ts) = 5 AND isodow(nx) = 1""",
}
