"""Comparison SQL of ``cross_queries``."""

from __future__ import annotations

from tidebars.plans import sql_parts as p
from tidebars.plans.series_sql import B1, B5, SQL as SERIES_SQL

_W = {"click": -0.576, "error": 0.136, "purchase": -0.119, "signup": 0.091, "view": 0.042}


def _value(side) -> str:
    return "50.14348112::DOUBLE * " + " * ".join(f"pow({s}.{side(w)} + 1, {w}::DOUBLE)" for s, w in _W.items())


_JOIN = " ".join(
    f"FROM (SELECT * FROM bars WHERE symbol = '{s}') {s}" if i == 0
    else f"JOIN (SELECT * FROM bars WHERE symbol = '{s}') {s} USING (ts)" for i, s in enumerate(_W))
_FOUR = f"""four AS (SELECT ts, {_value(lambda w: 'open')} AS open, {_value(lambda w: 'close')} AS close,
  {_value(lambda w: 'high' if w > 0 else 'low')} AS up, {_value(lambda w: 'low' if w > 0 else 'high')} AS dn {_JOIN})"""

_CROSS = f"""{B1},
base AS (SELECT ts, row_number() OVER (ORDER BY ts) AS brn FROM bars WHERE symbol = 'purchase'),
mi AS (SELECT 'i' AS symbol, ts, close, high, low FROM bars JOIN base USING (ts) WHERE symbol = 'click'),
mg AS (SELECT 'g' AS symbol, ts, close, high, low FROM bars JOIN base USING (ts) WHERE symbol = 'view'),
{p.numbered('b', 'mi', ', lag(close, 12) OVER w AS old')}, {p.rsi('s', 'b', 14)},
i AS (SELECT b.ts, b.rn AS k, CASE WHEN old <> 0 THEN (close - old) / old END AS ret, {p.RSI_VALUE.format('s')} AS rsi
      FROM b LEFT JOIN s USING (symbol, rn)),
{p.numbered('g0', 'mg', ', lag(close, 12) OVER w AS old')},
g AS (SELECT ts, rn AS k, close AS lvl, CASE WHEN old <> 0 THEN (close - old) / old END AS chg FROM g0),
pos AS (SELECT base.ts, max(i.k) OVER o AS ik, max(g.k) OVER o AS gk
        FROM base LEFT JOIN i ON i.ts = base.ts LEFT JOIN g ON g.ts = base.ts
        WINDOW o AS (ORDER BY base.ts ROWS UNBOUNDED PRECEDING))"""


def _observation() -> str:
    """Both windows by position among warm bars; the 4h window ends at the last bar completed by then."""
    head = SERIES_SQL["feature_table"]

    def features(bars_cte: str, suffix: str, label: str) -> str:
        body = head[len("WITH RECURSIVE "):]
        ctes, select = body[: body.index("\nSELECT b.symbol, '1h'")], body[body.index("\nSELECT b.symbol, '1h'"):]
        ctes = ctes.replace(B1 + ",", "", 1)
        return f"""f{suffix} AS (WITH RECURSIVE {ctes.replace('FROM bars WINDOW', f'FROM {bars_cte} WINDOW')} {select})"""

    cols = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in p.INPUTS)
    four = """b4 AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"""
    return f"""WITH {B1}, {four}, {features('bars', '1', '1h')}, {features('b4', '4', '4h')},
v1 AS (SELECT f1.symbol, f1.ts, row_number() OVER (PARTITION BY f1.symbol ORDER BY f1.ts) AS k,
         [bars.open, bars.high, bars.low, bars.close, bars.volume, {cols}] AS v
       FROM f1 JOIN bars ON bars.symbol = f1.symbol AND bars.ts = f1.ts WHERE warmup_complete),
v4 AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, [{cols}] AS v
       FROM f4 WHERE warmup_complete),
last4 AS (SELECT v1.symbol, v1.ts, v1.k, max(v4.k) AS k4 FROM v1 JOIN v4 ON v4.symbol = v1.symbol
            AND v4.ts + INTERVAL '4 hours' <= v1.ts GROUP BY ALL),
parts AS (
  SELECT l.symbol, l.ts, 0 AS w, v1.k AS k, v1.v FROM last4 l JOIN v1 ON v1.symbol = l.symbol
    AND v1.k BETWEEN l.k - 5 AND l.k WHERE l.k >= 6 AND l.k4 >= 3
  UNION ALL SELECT l.symbol, l.ts, 1, v4.k, v4.v FROM last4 l JOIN v4 ON v4.symbol = l.symbol
    AND v4.k BETWEEN l.k4 - 2 AND l.k4 WHERE l.k >= 6 AND l.k4 >= 3
  UNION ALL SELECT symbol, ts, 2, 0, [0.0::DOUBLE, 0.0, 0.0, 0.0] FROM last4 WHERE k >= 6 AND k4 >= 3)
SELECT symbol, ts, flatten(list(v ORDER BY w, k)) AS observation
FROM parts GROUP BY symbol, ts"""


SQL = {
    "aligned_pivot": f"WITH {B1} SELECT ts, {', '.join(f'{s}.close AS {s}' for s in _W)} {_JOIN}",
    "index_bars": f"""WITH {B1}, {_FOUR} SELECT 'INDEX' AS symbol, ts, {p.r('open', 'open')},
  {p.r('greatest(open, close, up, dn)', 'high')}, {p.r('least(open, close, up, dn)', 'low')}, {p.r('close', 'close')} FROM four""",
    "index_close_only": f"""WITH {B1}, {_FOUR} SELECT 'INDEX' AS symbol, ts, {p.r('close', 'open')}, {p.r('close', 'high')},
  {p.r('close', 'low')}, {p.r('close', 'close')} FROM four""",
    "index_missing": f"""WITH {B1}, all_ts AS (SELECT DISTINCT ts FROM bars), s AS (SELECT DISTINCT symbol FROM bars)
SELECT all_ts.ts, string_agg(s.symbol, ',' ORDER BY s.symbol) AS missing FROM all_ts, s
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ts = all_ts.ts AND b.symbol = s.symbol) GROUP BY all_ts.ts""",
    "index_coverage": f"""WITH {B1}, {_FOUR} SELECT (SELECT count(*) FROM bars) AS total_bars, count(*) AS index_bars,
  {p.r('min(close)', 'min_close')}, {p.r('max(close)', 'max_close')}, {p.r('avg(close)', 'avg_close')},
  {p.r('count(*) * 5 / (SELECT count(*) FROM bars)', 'coverage')},
  min(close) < 50 OR max(close) > 150 AS out_of_range FROM four""",
    "cross_asset_features": f"""WITH RECURSIVE {_CROSS}
SELECT 'purchase' AS symbol, pos.ts, {p.r('i.ret', 'dxy_return_1h')}, {p.r('i.rsi', 'dxy_rsi_14')},
  {p.r('g.lvl', 'vix_level')}, {p.r('g.chg', 'vix_change')}
FROM pos LEFT JOIN i ON i.k = pos.ik LEFT JOIN g ON g.k = pos.gk""",
    "asof_multi_tf": f"""WITH {B5}, h AS (SELECT symbol, time_bucket({p.HOUR}, ts) AS ts, arg_max(close, ts) AS hour_close,
  sum(volume) AS hour_volume FROM bars GROUP BY 1, 2), r AS (SELECT *, ts + {p.HOUR} AS ready FROM h)
SELECT bars.symbol, bars.ts, bars.close, r.ts AS asof_ts, r.hour_close, r.hour_volume
FROM bars ASOF LEFT JOIN r ON bars.symbol = r.symbol AND bars.ts >= r.ready""",
    "observation_vectors": _observation(),
}
