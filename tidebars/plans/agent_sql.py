"""Comparison SQL of ``agent_queries``: ledgers and statistics followed row by row."""

from __future__ import annotations

from tidebars.plans import sql_parts as p
from tidebars.plans.ingest_sql import _with_features
from tidebars.plans.series_sql import B1, B5

_SIZE, _HALF = "50.0::DOUBLE", "1.75::DOUBLE"
_LOG = f"""{B5},
lg AS (SELECT CASE symbol WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5
         ELSE 0 END * 100 + CAST(floor(epoch(ts) / 604800) AS BIGINT) % 100 AS ep, symbol, ts, close + 1500 AS px,
         CASE WHEN close < 15 THEN 1 WHEN close > 90 THEN 2 WHEN close > 60 THEN 0 WHEN hour(ts) % 2 = 0 THEN 1 ELSE 2 END AS a,
         open AS atr, high AS rsi, CASE WHEN hour(ts) < 8 THEN 'ranging' WHEN hour(ts) < 16 THEN 'low_vol_trend' END AS regime FROM bars),
l0 AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY ts) AS st FROM lg),
l AS (SELECT *, max(st) OVER (PARTITION BY ep) AS last_st FROM l0 WHERE st <= 2016)"""


def _dir(a: str) -> str:
    return f"CASE {a} WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"


# step by step: cash first, then the mark to market, then the margin rule
_WALK = f"""{_LOG}, walk AS (
  SELECT DISTINCT ep, CAST(0 AS BIGINT) AS st, 0 AS pos, 0.0::DOUBLE AS entry, 10000.0::DOUBLE AS bal, 10000.0::DOUBLE AS peak, 0 AS held,
    CAST(0 AS BIGINT) AS tr, 0.0::DOUBLE AS fees, 0.0::DOUBLE AS cum, 0.0::DOUBLE AS realized, 0.0::DOUBLE AS unreal, FALSE AS opened,
    FALSE AS closed, FALSE AS liq, FALSE AS done, 0 AS p0, 0.0::DOUBLE AS margin FROM l
  UNION ALL
  SELECT ep, st, CASE WHEN fin THEN 0 ELSE a END, entry, bal + CASE WHEN fin THEN unreal - {_HALF} ELSE 0 END, peak,
    CASE WHEN fin OR a = 0 THEN 0 ELSE held END, tr + CASE WHEN fin THEN 1 ELSE 0 END, fees + CASE WHEN fin THEN {_HALF} ELSE 0 END,
    cum + CASE WHEN fin THEN unreal - {_HALF} ELSE 0 END, realized + CASE WHEN fin THEN unreal - {_HALF} ELSE 0 END,
    CASE WHEN fin THEN 0 ELSE unreal END, opened, closed OR fin, liq, liq OR st = last_st, p0, CASE WHEN fin THEN 0 ELSE margin END
  FROM (
    SELECT *, (liq OR st = last_st) AND a <> 0 AS fin FROM (
      SELECT *, a <> 0 AND bal + unreal <= margin * 0.5 AS liq,
        CASE WHEN a <> 0 THEN greatest(k0, bal + unreal) ELSE k0 END AS peak FROM (
        SELECT *, {_dir('a')} * (px - entry) * {_SIZE} AS unreal, CASE WHEN a <> 0 THEN px * {_SIZE} / 100 ELSE 0 END AS margin FROM (
          SELECT *, CASE WHEN opened THEN px ELSE e0 END AS entry, CASE WHEN opened THEN 1 ELSE h0 + 1 END AS held,
            b0 + gross - {_HALF} * (CAST(opened AS INTEGER) + CAST(closed AS INTEGER)) AS bal,
            f0 + {_HALF} * (CAST(opened AS INTEGER) + CAST(closed AS INTEGER)) AS fees,
            t0 + CAST(closed AS INTEGER) AS tr, CASE WHEN closed THEN gross - {_HALF} ELSE 0 END AS realized,
            c0 + CASE WHEN closed THEN gross - {_HALF} ELSE 0 END AS cum FROM (
            SELECT *, CASE WHEN closed THEN {_dir('p0')} * (px - e0) * {_SIZE} ELSE 0 END AS gross FROM (
              SELECT x.ep, x.st, x.px, x.a, x.last_st, s.pos AS p0, s.entry AS e0, s.bal AS b0, s.peak AS k0, s.held AS h0,
                s.tr AS t0, s.fees AS f0, s.cum AS c0, x.a <> 0 AND x.a <> s.pos AS opened, s.pos <> 0 AND x.a <> s.pos AS closed
              FROM walk s JOIN l x ON x.ep = s.ep AND x.st = s.st + 1 WHERE NOT s.done) q1) q2) q3) q4) q5) q6),
led AS (SELECT walk.*, l.px, l.atr, l.rsi, l.regime, (peak - bal - unreal) / peak * 100 AS dd FROM walk JOIN l USING (ep, st))"""

_KEYS = "ep AS episode_id, CAST(st AS INTEGER) AS step"
_PNL = "CASE WHEN closed THEN realized WHEN pos <> 0 THEN unreal * 0.5 ELSE -0.0001 END"
_RISK = f"""{_PNL} - CASE WHEN dd > 0.02 THEN (dd - 0.02::DOUBLE) * 10 ELSE 0 END
  + CASE WHEN pos <> 0 AND regime = 'low_vol_trend' THEN 0.1 WHEN pos <> 0 AND regime = 'ranging' THEN -0.1 ELSE 0 END
  + CASE WHEN pos <> p0 THEN -0.02 ELSE 0 END + CASE WHEN held > 48 THEN (held - 48) * -0.0002 ELSE 0 END"""

_SHARPE = f"""{_WALK}, rt AS (SELECT ep, st, coalesce((bal - lag(bal) OVER w) / lag(bal) OVER w, 0) AS r FROM led WINDOW w AS (PARTITION BY ep ORDER BY st)),
ab AS (
  SELECT ep, st, r, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM rt WHERE st = 1
  UNION ALL
  SELECT x.ep, x.st, x.r, s.a, s.b, s.a + 0.01::DOUBLE * (x.r - s.a), s.b + 0.01::DOUBLE * (x.r * x.r - s.b)
  FROM ab s JOIN rt x ON x.ep = s.ep AND x.st = s.st + 1)"""


def _online(key: str, source: str, value: str, name: str) -> str:
    """Row-by-row statistics of one column per key: mean m, variance v and the score z."""
    return f"""{name}0 AS (SELECT *, {value} AS val, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS rn FROM {source}),
{name} AS (
  SELECT {key}, rn, ts, val, val AS m, 0.0::DOUBLE AS v FROM {name}0 WHERE rn = 1
  UNION ALL
  SELECT {', '.join(f'x.{k.strip()}' for k in key.split(','))}, x.rn, x.ts, x.val,
    CASE WHEN x.rn <= 20 THEN s.m + (x.val - s.m) / x.rn ELSE c.al * s.m + (1 - c.al) * d.cl END,
    CASE WHEN x.rn <= 20 THEN s.v + ((x.val - s.m) * (x.val - (s.m + (x.val - s.m) / x.rn)) - s.v) / x.rn
         ELSE c.al * s.v + (1 - c.al) * (d.cl - (c.al * s.m + (1 - c.al) * d.cl)) * (d.cl - (c.al * s.m + (1 - c.al) * d.cl)) END
  FROM {name} s JOIN {name}0 x ON {' AND '.join(f'x.{k.strip()} = s.{k.strip()}' for k in key.split(','))} AND x.rn = s.rn + 1,
    LATERAL (SELECT CASE WHEN epoch(x.ts) - epoch(s.ts) > 180 * 60 THEN 0.485::DOUBLE ELSE 0.97::DOUBLE END AS al) c,
    LATERAL (SELECT CASE WHEN sqrt(greatest(s.v, 0)) > 1e-10
      THEN greatest(s.m - 5 * sqrt(s.v), least(s.m + 5 * sqrt(s.v), x.val)) ELSE x.val END AS cl) d)"""


_Z = ("greatest(-5, least(5, CASE WHEN {0}.rn < 20 THEN {0}.val WHEN sqrt(greatest({0}.v, 0)) < 1e-10 THEN 0 "
      "ELSE ({0}.val - {0}.m) / sqrt({0}.v) END))")
_SESSION = """CASE WHEN hour(ts) BETWEEN 7 AND 11 THEN 'london' WHEN hour(ts) BETWEEN 12 AND 15 THEN 'overlap'
  WHEN hour(ts) BETWEEN 16 AND 21 THEN 'ny' ELSE 'asian' END"""


def _scores(key: str) -> str:
    source = f"sb AS (SELECT *, {_SESSION} AS sess FROM bars)"
    return f"""WITH RECURSIVE {B1}, {source}, {_online(key, 'sb', 'close', 'oc')}, {_online(key, 'sb', 'ln(greatest(volume, 1e-10))', 'ov')}
SELECT oc.symbol, oc.ts, {p.r(_Z.format('oc'), 'close_z', 5)}, {p.r(_Z.format('ov'), 'volume_z', 5)}
FROM oc JOIN ov ON ov.symbol = oc.symbol AND ov.ts = oc.ts"""


_SCORED = ["macd_line", "macd_signal", "macd_histogram", "atr_14", "vix_change", "dxy_return_1h"]
_LOGGED = ["bb_width", "rolling_volatility_20", "vix_level"]
_BY_VOL = ["return_1bar", "return_5bar", "return_12bar", "momentum_48"]
_SPAN = {"rsi_14": 100, "rsi_7": 100, "dxy_rsi_14": 100, "hour_of_day": 23, "day_of_week": 6}


def _by_class() -> str:
    parts, columns, joins = [], [], []
    for c in p.INPUTS:
        x = f"coalesce(CAST(w.{c} AS DOUBLE), 0)"
        if c in _SCORED or c in _LOGGED:
            value = f"coalesce(CAST({c} AS DOUBLE), 0)"
            parts.append(_online("symbol", "wf", f"ln(greatest({value}, 1e-10))" if c in _LOGGED else value, f"o_{c}"))
            joins.append(f"JOIN o_{c} ON o_{c}.symbol = w.symbol AND o_{c}.ts = w.ts")
            out = _Z.format(f"o_{c}")
        elif c in _BY_VOL:
            out = f"greatest(-5, least(5, CASE WHEN w.pv > 1e-8 THEN {x} / w.pv ELSE {x} END))"
        else:
            out = f"greatest(-5, least(5, {x} / {_SPAN.get(c, 1)}))"
        columns.append(p.r(out, c, 6 if c in _SCORED + _LOGGED + _BY_VOL else 8))
    return _with_features(f""", wf AS (SELECT *, lag(rolling_volatility_20) OVER (PARTITION BY symbol ORDER BY ts) AS pv FROM ft
  WHERE warmup_complete), {', '.join(parts)} SELECT w.symbol, w.ts, {', '.join(columns)} FROM wf w {' '.join(joins)}""")


SQL = {
    "feature_specific_norm": _by_class(),
    "account_ledger": f"""WITH RECURSIVE {_WALK} SELECT {_KEYS}, pos AS position, opened AS trade_opened, closed AS trade_closed,
  {p.r('realized', 'realized_pnl', 4)}, {p.r('unreal', 'unrealized_pnl', 4)}, {p.r('bal', 'balance', 4)},
  {p.r('bal + unreal', 'equity', 4)}, {p.r('peak', 'peak_equity', 4)}, {p.r('dd', 'drawdown_pct', 4)},
  {p.r('margin', 'margin_used', 4)}, held AS bars_held, tr AS total_trades, {p.r('fees', 'commission_paid', 4)},
  {p.r('cum', 'cumulative_realized', 4)}, liq AS is_liquidated, done AS episode_end FROM led""",
    "rewards_pnl": f"""WITH RECURSIVE {_WALK} SELECT {_KEYS}, {p.r(_PNL, 'plain', 4)},
  {p.r(f'CASE WHEN atr > 0 AND (closed OR pos <> 0) THEN ({_PNL}) / (atr * 0.1::DOUBLE) ELSE {_PNL} END', 'scaled', 4)} FROM led""",
    "rewards_risk": f"WITH RECURSIVE {_WALK} SELECT {_KEYS}, {p.r(_RISK, 'reward', 4)} FROM led",
    "rewards_sharpe": f"""WITH RECURSIVE {_SHARPE} SELECT {_KEYS}, {p.r('''CASE WHEN st <= 21 OR b0 - a0 * a0 < 1e-6 THEN 0
  ELSE greatest(-1, least(1, 100 * (b0 * (r - a0) - 0.5 * a0 * (r * r - b0)) / (pow(b0 - a0 * a0, 1.5) + 1e-8))) END''', 'reward', 5)} FROM ab""",
    "position_features": f"""WITH RECURSIVE {_WALK} SELECT {_KEYS},
  [round(x, 5) + 0.0 for x in [atr, rsi, CAST(pos AS DOUBLE), unreal / 10000]] AS observation, {p.r('px', 'margin_per_lot', 5)} FROM led""",
    "reward_context": f"""WITH RECURSIVE {_WALK} SELECT {_KEYS}, pos AS position, {p.r('bal', 'balance', 4)}, {p.r('dd', 'drawdown_pct', 4)},
  {p.r('b.high', 'atr_14', 4)}, {p.r('b.low', 'rsi_14', 4)}, {p.r('led.px', 'margin_per_lot', 4)}
FROM led JOIN l USING (ep, st) LEFT JOIN bars b ON b.ts = l.ts AND b.symbol = l.symbol""",
    "evaluation_episodes": f"""WITH {B1} SELECT symbol, ts, CAST(0 AS BIGINT) AS episode_id,
  CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INTEGER) AS step, close FROM bars""",
    "training_episodes": f"""WITH {B5}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars),
e AS (SELECT symbol, k AS episode_id, k * 7919 % (max(n) - 96) AS start FROM n, range(40) t(k) GROUP BY symbol, k)
SELECT n.symbol, n.ts, e.episode_id, CAST(n.pos - e.start AS INTEGER) AS step, n.close FROM e JOIN n ON n.symbol = e.symbol
  AND n.pos BETWEEN e.start AND e.start + 96""",
    "online_zscore": _scores("symbol"),
    "online_zscore_sessions": _scores("symbol, sess"),
}
