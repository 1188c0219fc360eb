"""Comparison SQL of ``model_queries``."""

from __future__ import annotations

from itertools import combinations

from tidebars.plans import sql_parts as p
from tidebars.plans.series_sql import _ADX, B1, B5

_ATR14 = f"t AS (SELECT *, {p.TR.format('b')} AS tr FROM b), {p.wilder('atr', 't', 'tr')}"
_W = "(PARTITION BY symbol ORDER BY ts)"
_WF = """n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM {src}),
wf AS (SELECT n.*, i AS fold, CASE WHEN pos < (n // 6) * (i + 1) THEN 'train'
       WHEN pos >= (n // 6) * (i + 1) + 1 AND pos < (n // 6) * (i + 2) + 1 THEN 'test' END AS role
       FROM n, (VALUES (0), (1), (2), (3), (4)) f(i))"""


def _cpcv() -> str:
    rows = []
    for fold, chosen in enumerate(combinations(range(5), 2)):
        test = " OR ".join(f"g = {g}" for g in chosen)
        drop = " OR ".join(
            f"(pos >= (n // 5) * {g} - 1 AND pos < (n // 5) * {g}) OR (pos >= e{g} AND pos < e{g} + greatest(1, CAST(floor(n * 0.01) AS BIGINT)))"
            for g in chosen)
        rows.append(f"SELECT symbol, ts, {fold} AS fold, CASE WHEN {test} THEN 'test' WHEN NOT ({drop}) THEN 'train' END AS role FROM g")
    ends = ", ".join(f"{'n' if g == 4 else f'(n // 5) * {g + 1}'} AS e{g}" for g in range(5))
    return f"""WITH {B5}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars), g AS (SELECT *, least(pos // (n // 5), 4) AS g, {ends} FROM n)
SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE role IS NOT NULL"""


_LR = f"""{p.numbered(extra=p.LAGS)}, {p.VOL20}"""
_FOLDS = f"""{B1}, {_LR},
rows0 AS (SELECT symbol, ts, r5, lead(close, 6) OVER {_W} AS later, close FROM rt),
rows1 AS (SELECT symbol, ts, CASE WHEN r5 > 0 THEN 1.0 ELSE 0.0 END AS prediction,
  CASE WHEN later - close > 0 THEN 1.0 ELSE 0.0 END AS label,
  coalesce((later - close) / (close + 1500), 0) AS fr FROM rows0 WHERE later IS NOT NULL AND r5 IS NOT NULL),
{_WF.format(src='rows1')}, te AS (SELECT *, CASE WHEN prediction = 1 THEN fr ELSE -fr END AS r FROM wf WHERE role = 'test'),
cum AS (SELECT *, sum(r) OVER (PARTITION BY symbol, fold ORDER BY ts) AS eq FROM te),
dd AS (SELECT *, max(eq) OVER (PARTITION BY symbol, fold ORDER BY ts) - eq AS d FROM cum),
m AS (SELECT symbol, CAST(fold AS INTEGER) AS fold,
  avg(r) / stddev_samp(r) * sqrt(252 * 78 / 6.0) AS sharpe_ratio,
  avg(r) / stddev_samp(r) FILTER (WHERE r < 0) * sqrt(252 * 78 / 6.0) AS sortino_ratio,
  sum(r) FILTER (WHERE r > 0) / abs(sum(r) FILTER (WHERE r < 0)) AS profit_factor,
  avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, max(d) AS max_drawdown, count(*) AS trade_count,
  sum(r) AS total_return, avg(r) AS mean_return, stddev_samp(r) AS std_return,
  avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM dd GROUP BY symbol, fold)"""
_METRICS = ["sharpe_ratio", "sortino_ratio", "profit_factor", "win_rate", "max_drawdown", "total_return", "mean_return",
            "std_return", "accuracy"]
_GATES = {"sharpe_ratio": "1.0", "sortino_ratio": "1.5", "profit_factor": "1.3", "win_rate": "0.40",
          "max_drawdown": "0.20", "trade_count": "100"}
_TARGETS = {"sharpe_ratio": "1.5", "sortino_ratio": "2.0", "profit_factor": "1.5", "win_rate": "0.50",
            "max_drawdown": "0.15", "trade_count": "200"}


def _gate(table: dict) -> str:
    return " AND ".join(f"{k} {'<=' if k == 'max_drawdown' else '>='} {v}" for k, v in table.items())


def _state(a: str = "y", expanding: str = "x") -> tuple[str, str]:
    explicit = f"CASE WHEN {a} IS NULL THEN NULL WHEN {expanding} THEN 'high_vol_trend' WHEN {a} < 20 THEN 'ranging' WHEN {a} > 25 THEN 'low_vol_trend' END"
    conf = f"""CASE WHEN {a} IS NULL THEN 0.5 WHEN {expanding} THEN least({a} / 50, 1.0)
  WHEN {a} < 20 THEN greatest(0.5, least(1 - {a} / 20, 1.0)) WHEN {a} > 25 THEN greatest(0.5, least({a} / 50, 1.0)) ELSE 0.5 END"""
    return explicit, conf


_EXPLICIT, _CONF = _state()

_INTRADAY = f"""{B1}, {_ADX}, {_ATR14},
j AS (SELECT b.symbol, b.ts, adx.y, atr.y AS atr, lag(atr.y) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS prev
      FROM b LEFT JOIN adx USING (symbol, rn) LEFT JOIN atr USING (symbol, rn)),
x AS (SELECT *, coalesce(prev > 0 AND atr / prev >= 1.5, FALSE) AS x FROM j),
e AS (SELECT *, {_EXPLICIT} AS explicit, {_CONF} AS conf FROM x),
i AS (SELECT symbol, ts, coalesce(last_value(explicit IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
  'ranging') AS istate, conf, x FROM e)"""

_GATE = f"""{_INTRADAY},
q AS (SELECT *, isodow(ts) AS d, hour(ts) % 7 = 0 AS chg, hour(ts) AS h FROM i),
sc AS (SELECT *,
  CASE WHEN istate = 'low_vol_trend' THEN 0.6::DOUBLE * conf ELSE 0 END + CASE WHEN d = 1 THEN 0.3::DOUBLE * 0.9::DOUBLE ELSE 0 END AS s1,
  CASE WHEN istate = 'high_vol_trend' THEN 0.6::DOUBLE * conf ELSE 0 END + CASE WHEN d = 2 THEN 0.3::DOUBLE * 0.9::DOUBLE ELSE 0 END
    + CASE WHEN chg THEN 0.1::DOUBLE ELSE 0 END AS s2,
  CASE WHEN istate = 'ranging' THEN 0.6::DOUBLE * conf ELSE 0 END + CASE WHEN d = 3 THEN 0.3::DOUBLE * 0.9::DOUBLE ELSE 0 END AS s3 FROM q),
vt AS (SELECT symbol, ts, h, chg, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
  CASE WHEN d > 3 THEN istate WHEN s1 >= s2 AND s1 >= s3 THEN 'low_vol_trend' WHEN s2 >= s3 THEN 'high_vol_trend' ELSE 'ranging' END AS p,
  CASE WHEN d > 3 THEN conf * CASE WHEN chg THEN 0.9 ELSE 1 END ELSE greatest(s1, s2, s3) / (s1 + s2 + s3) END AS vc FROM sc),
st AS (
  SELECT symbol, rn, 'ranging' AS cur, CASE WHEN p <> 'ranging' THEN 1 ELSE 0 END AS k FROM vt WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, CASE WHEN b.p <> s.cur AND s.k >= 2 THEN b.p ELSE s.cur END,
    CASE WHEN b.p <> s.cur AND s.k < 2 THEN s.k + 1 ELSE 0 END FROM st s JOIN vt b ON b.symbol = s.symbol AND b.rn = s.rn + 1),
g AS (SELECT *, CASE WHEN h = 7 THEN 1.2 WHEN h BETWEEN 12 AND 15 THEN 1.3 WHEN h BETWEEN 17 AND 21 THEN 0.3
       WHEN h >= 22 OR h < 7 THEN 0.7 ELSE 1.0 END AS bias FROM vt JOIN st USING (symbol, rn))"""

_PERSIST = f"""{B5}, b AS (SELECT symbol, ts, row_number() OVER {_W} AS rn,
  CASE WHEN close > 120 THEN 'high_vol_trend' WHEN close > 40 THEN 'low_vol_trend' ELSE 'ranging' END AS proposed_state FROM bars),
st AS (
  SELECT symbol, rn, 'ranging' AS cur, CASE WHEN proposed_state <> 'ranging' THEN 1 ELSE 0 END AS k FROM b WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, CASE WHEN b.proposed_state <> s.cur AND s.k >= 2 THEN b.proposed_state ELSE s.cur END,
    CASE WHEN b.proposed_state <> s.cur AND s.k < 2 THEN s.k + 1 ELSE 0 END
  FROM st s JOIN b ON b.symbol = s.symbol AND b.rn = s.rn + 1)"""


def _trades(bars: str, horizon: int, spread: str, gate: str, lift: int = 0) -> str:
    """Bar by bar: how many bars are left to hold before and after each bar."""
    return f"""{bars}, {_LR},
sg AS (SELECT symbol, ts, rn, open + {lift} AS open, close + {lift} AS close, volume, CASE WHEN r5 < -1 THEN 'long' WHEN r5 > 1 THEN 'short' END AS side,
  lead(open) OVER {_W} + {lift} AS nopen, lead(ts) OVER {_W} AS nts, max(rn) OVER (PARTITION BY symbol) AS last_rn FROM rt),
cd AS (SELECT *, side IS NOT NULL AND nopen > 0 AND {gate} AS cand FROM sg),
hold AS (
  SELECT symbol, rn, CASE WHEN cand THEN {horizon} ELSE 0 END AS left_after, cand AS entered FROM cd WHERE rn = 1
  UNION ALL
  SELECT cd.symbol, cd.rn, CASE WHEN h.left_after <= 1 AND cd.cand THEN {horizon} ELSE greatest(h.left_after - 1, 0) END,
    h.left_after <= 1 AND cd.cand FROM hold h JOIN cd ON cd.symbol = h.symbol AND cd.rn = h.rn + 1),
tr AS (
  SELECT e.symbol, e.side AS direction, e.nts AS entry_ts, e.nopen AS entry_price, x.ts AS exit_ts, x.close AS exit_price,
    CAST(x.rn - e.rn AS INTEGER) AS bars_held, CASE WHEN e.volume > 2 THEN 'high_vol_trend' ELSE 'ranging' END AS regime_state,
    100 * ((CASE WHEN e.side = 'long' THEN x.close - e.nopen ELSE e.nopen - x.close END) / e.nopen - {spread} / e.nopen) AS pnl_pct
  FROM hold h JOIN cd e ON e.symbol = h.symbol AND e.rn = h.rn
    JOIN cd x ON x.symbol = e.symbol AND x.rn = least(e.rn + {horizon}, e.last_rn) WHERE h.entered)"""


_T5 = _trades(B5, 12, "0.3", "hour(ts) <> 3", 1500)
_GROW = "(exp(sum(ln(1 + pnl_pct / 100))) - 1) * 100"
_SHARPE = "CASE WHEN count(*) > 1 AND stddev_samp(pnl_pct) > 0 THEN avg(pnl_pct) / stddev_samp(pnl_pct) * sqrt(252 * 6.5 / avg(bars_held)) ELSE 0 END"
_DOWN = "stddev_samp(pnl_pct) FILTER (WHERE pnl_pct < 0)"


def _grid() -> str:
    parts = []
    for h in (3, 6):
        body = _trades(B1, h, "0", "TRUE")
        parts.append(f"""(WITH RECURSIVE {body} SELECT symbol, {h} AS horizon, s AS spread, count(*) AS trades,
  {p.r('sum(pnl_pct - 100 * s / entry_price)', 'pnl', 4)} FROM tr, (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (1.0::DOUBLE)) g(s)
  GROUP BY symbol, s)""")
    return " UNION ALL ".join(parts)

_METRIC_CURVE = f"""cu AS (SELECT *, exp(sum(ln(1 + pnl_pct / 100)) OVER (PARTITION BY symbol ORDER BY exit_ts)) AS eq FROM c),
dd AS (SELECT *, (max(eq) OVER (PARTITION BY symbol ORDER BY exit_ts) - eq) / max(eq) OVER (PARTITION BY symbol ORDER BY exit_ts) AS d FROM cu)"""
_METRIC_COLUMNS = f"""{p.r(_GROW, 'total_return', 5)}, {p.r(_SHARPE, 'sharpe_ratio', 5)},
  {p.r(f'avg(pnl_pct) / {_DOWN} * sqrt(252 * 6.5 / avg(bars_held))', 'sortino_ratio', 5)},
  {p.r('least(sum(pnl_pct) FILTER (WHERE pnl_pct > 0) / abs(sum(pnl_pct) FILTER (WHERE pnl_pct <= 0)), 99.99)', 'profit_factor', 5)},
  {p.r('100 * avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate', 5)}, {p.r('100 * max(d)', 'max_drawdown', 5)},
  count(*) AS trade_count, {p.r('avg(pnl_pct) FILTER (WHERE pnl_pct > 0)', 'avg_win', 5)},
  {p.r('avg(pnl_pct) FILTER (WHERE pnl_pct <= 0)', 'avg_loss', 5)}, {p.r('max(pnl_pct)', 'best_trade', 5)},
  {p.r('min(pnl_pct)', 'worst_trade', 5)}"""


def _gated() -> str:
    """Bar by bar, with the dead zone, persistence and holding all in one row that moves on only where it may."""
    return f"""{_INTRADAY}, {_LR.replace('b AS (', 'b2 AS (').replace('FROM b)', 'FROM b2)')},
sig AS MATERIALIZED (SELECT symbol, ts, rn, open + 1500 AS open, close + 1500 AS close, CASE WHEN r5 < -1 THEN 'long' WHEN r5 > 1 THEN 'short' END AS side,
  lead(open) OVER {_W} + 1500 AS nopen, lead(ts) OVER {_W} AS nts, max(rn) OVER (PARTITION BY symbol) AS last_rn FROM rt),
ask AS (SELECT sig.*, e.explicit, e.conf, e.y IS NOT NULL AS warm, isodow(e.ts) AS d, hour(e.ts) % 7 = 0 AS chg, hour(e.ts) AS h
  FROM sig JOIN e ON e.symbol = sig.symbol AND e.ts = sig.ts),
sc AS (SELECT ask.*, z,
  CASE WHEN z = 'low_vol_trend' THEN 0.6::DOUBLE * conf ELSE 0 END + CASE WHEN d = 1 THEN 0.3::DOUBLE * 0.9::DOUBLE ELSE 0 END AS s1,
  CASE WHEN z = 'high_vol_trend' THEN 0.6::DOUBLE * conf ELSE 0 END + CASE WHEN d = 2 THEN 0.3::DOUBLE * 0.9::DOUBLE ELSE 0 END
    + CASE WHEN chg THEN 0.1::DOUBLE ELSE 0 END AS s2,
  CASE WHEN z = 'ranging' THEN 0.6::DOUBLE * conf ELSE 0 END + CASE WHEN d = 3 THEN 0.3::DOUBLE * 0.9::DOUBLE ELSE 0 END AS s3
  FROM ask, (VALUES ('low_vol_trend'), ('high_vol_trend'), ('ranging')) v(z)),
vt AS MATERIALIZED (SELECT *,
  CASE WHEN d > 3 THEN z WHEN s1 >= s2 AND s1 >= s3 THEN 'low_vol_trend' WHEN s2 >= s3 THEN 'high_vol_trend' ELSE 'ranging' END AS p,
  NOT (h BETWEEN 17 AND 21) AND CASE WHEN d > 3 THEN conf * CASE WHEN chg THEN 0.9 ELSE 1 END ELSE greatest(s1, s2, s3) / (s1 + s2 + s3) END >= 0.6 AS may FROM sc),
mac AS (
  SELECT DISTINCT symbol, 0::BIGINT AS rn, 'ranging' AS z, 'ranging' AS cur, 0 AS k, 0 AS held, FALSE AS asked, FALSE AS entered FROM sig
  UNION ALL
  SELECT v.symbol, v.rn, CASE WHEN v.warm AND m.held <= 1 THEN v.z ELSE m.z END,
    CASE WHEN v.warm AND m.held <= 1 AND v.p <> m.cur AND m.k >= 2 THEN v.p ELSE m.cur END,
    CASE WHEN NOT (v.warm AND m.held <= 1) THEN m.k WHEN v.p <> m.cur AND m.k < 2 THEN m.k + 1 ELSE 0 END,
    CASE WHEN v.warm AND m.held <= 1 AND v.may AND v.side IS NOT NULL AND v.nopen > 0 THEN 6 ELSE greatest(m.held - 1, 0) END,
    v.warm AND m.held <= 1 AND v.may, v.warm AND m.held <= 1 AND v.may AND v.side IS NOT NULL AND coalesce(v.nopen > 0, FALSE)
  FROM mac m JOIN vt v ON v.symbol = m.symbol AND v.rn = m.rn + 1 AND v.z = coalesce(v.explicit, m.z)),
tr AS (
  SELECT s.symbol, s.side AS direction, s.nts AS entry_ts, s.nopen AS entry_price, x.ts AS exit_ts, x.close AS exit_price,
    CAST(x.rn - s.rn AS INTEGER) AS bars_held, m.cur AS regime_state,
    100 * ((CASE WHEN s.side = 'long' THEN x.close - s.nopen ELSE s.nopen - x.close END) / s.nopen - 0.3 / s.nopen) AS pnl_pct
  FROM mac m JOIN sig s ON s.symbol = m.symbol AND s.rn = m.rn
    JOIN sig x ON x.symbol = s.symbol AND x.rn = least(s.rn + 6, s.last_rn) WHERE m.entered)"""


_DAILY = f"""{p.order_bars()}, {p.numbered()},
a AS (SELECT *, (close - pc) / nullif(pc, 0) AS r FROM b), l AS (SELECT *, lag(r) OVER {_W} AS lr FROM a),
m AS (SELECT *, count(r) OVER v AS n, stddev_samp(r) OVER v AS sd, covar_samp(r, lr) OVER k AS cv, var_samp(r) OVER k AS va,
      count(CASE WHEN r IS NOT NULL AND lr IS NOT NULL THEN 1 END) OVER k AS pairs, count(r) OVER k AS rs FROM l
      WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), k AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
day AS (SELECT symbol, ts, row_number() OVER {_W} AS k, sd AS vol,
  CASE WHEN pairs >= 10 AND rs >= 10 AND va <> 0 THEN greatest(-1, least(1, cv / va)) ELSE 0 END AS ac FROM m WHERE n >= 5 AND sd IS NOT NULL)"""
_STATES3 = [("0.5", "2.0", "4.0", "-0.3", "0.05"), ("0.3", "10.0", "60.0", "-0.1", "0.05"), ("0.2", "40.0", "900.0", "0.1", "0.1")]
_MOVES = [["0.9", "0.08", "0.02"], ["0.1", "0.85", "0.05"], ["0.05", "0.15", "0.8"]]
_NAMES3 = ["ranging", "low_vol_trend", "high_vol_trend"]


def _hidden() -> str:
    """Densities of each day, then one day after another: predict, weigh, normalize."""
    density = ", ".join(f"-0.5::DOUBLE * ((vol - {m}) ** 2 / {v} + (ac - ({c})) ** 2 / {w} + ln({v}::DOUBLE * {w}::DOUBLE) + 2 * ln(2 * pi())) AS d{i}"
                        for i, (_, m, v, c, w) in enumerate(_STATES3))
    weight = ", ".join(f"greatest(exp(d{i} - greatest(d0, d1, d2)), 1e-300) AS b{i}" for i in range(3))
    into = [" + ".join(f"h.a{i} * {_MOVES[i][j]}::DOUBLE" for i in range(3)) for j in range(3)]
    first = ", ".join(f"{_STATES3[i][0]}::DOUBLE * b{i} / ({' + '.join(f'{_STATES3[k][0]}::DOUBLE * b{k}' for k in range(3))}) AS a{i}" for i in range(3))
    total = " + ".join(f"({into[j]}) * w.b{j}" for j in range(3))
    step = ", ".join(f"({into[j]}) * w.b{j} / ({total})" for j in range(3))
    name = "CASE WHEN a0 >= a1 AND a0 >= a2 THEN 'ranging' WHEN a1 >= a2 THEN 'low_vol_trend' ELSE 'high_vol_trend' END"
    return f"""{_DAILY}, e AS (SELECT *, {density} FROM day), w AS (SELECT symbol, ts, k, vol, ac, {weight} FROM e),
h AS (SELECT symbol, k, {first} FROM w WHERE k = 1
  UNION ALL SELECT w.symbol, w.k, {step} FROM h JOIN w ON w.symbol = h.symbol AND w.k = h.k + 1),
hs AS (SELECT w.symbol, w.ts, w.k, w.vol, w.ac, {name} AS hmm_state, greatest(a0, a1, a2) AS hmm_prob FROM h JOIN w USING (symbol, k))"""


_CELLS = ", ".join(f"('{a}', '{b}', {_MOVES[i][j]}::DOUBLE)" for i, a in enumerate(_NAMES3) for j, b in enumerate(_NAMES3))

SQL = {
    "hmm_filter": f"""WITH RECURSIVE {_hidden()} SELECT symbol, ts, hmm_state, {p.r('hmm_prob', 'hmm_prob', 5)} FROM hs""",
    "hmm_state_report": f"""WITH RECURSIVE {_hidden()} SELECT symbol, hmm_state, count(*) AS rows, {p.r('avg(vol)', 'mean_vol', 5)}, {p.r('avg(ac)', 'mean_ac', 5)},
  {p.r('count(*) / sum(count(*)) OVER (PARTITION BY symbol)', 'share', 5)} FROM hs GROUP BY symbol, hmm_state""",
    "hmm_transition_report": f"""WITH RECURSIVE {_hidden()},
pairs AS (SELECT symbol, lag(hmm_state) OVER (PARTITION BY symbol ORDER BY k) AS f, hmm_state AS t FROM hs),
seen AS (SELECT symbol, f, t, count(*) AS times FROM pairs WHERE f IS NOT NULL GROUP BY ALL),
cells AS (SELECT symbol, c.f, c.t, c.p FROM (SELECT DISTINCT symbol FROM day), (VALUES {_CELLS}) c(f, t, p))
SELECT cells.symbol, {p.r('p', 'probability', 5)}, cells.f AS from_state, cells.t AS to_state, coalesce(times, 0) AS times
FROM cells LEFT JOIN seen ON seen.symbol = cells.symbol AND seen.f = cells.f AND seen.t = cells.t""",
    "gated_trades": f"""WITH RECURSIVE {_gated()} SELECT symbol, direction, entry_ts, {p.r('entry_price', 'entry_price')}, exit_ts,
  {p.r('exit_price', 'exit_price')}, bars_held, {p.r('pnl_pct', 'pnl_pct')}, regime_state FROM tr""",
    "gated_by_regime": f"""WITH RECURSIVE {_gated()} SELECT symbol, regime_state, count(*) AS trade_count,
  {p.r('100 * avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate', 5)}, {p.r(_SHARPE, 'sharpe_ratio', 5)},
  {p.r(_GROW, 'total_return', 5)} FROM tr GROUP BY symbol, regime_state""",
    "gated_backtest": f"""WITH RECURSIVE {_gated()}, c AS (SELECT * FROM tr), {_METRIC_CURVE},
n AS (SELECT symbol, count(*) AS bars_processed FROM sig GROUP BY symbol), g AS (SELECT symbol, count(*) AS signals_generated FROM mac WHERE asked GROUP BY symbol),
r AS (SELECT symbol, {_METRIC_COLUMNS} FROM dd GROUP BY symbol)
SELECT *, sharpe_ratio >= 1.0 AND sortino_ratio >= 1.5 AND profit_factor >= 1.3 AND win_rate >= 40 AS meets_minimum
FROM n JOIN g USING (symbol) JOIN r USING (symbol)""",
    "labels_sign": f"""WITH {B5} SELECT symbol, ts, CASE WHEN lead(close, 24) OVER w - close > 0 THEN 1.0::DOUBLE
  WHEN lead(close, 24) OVER w - close <= 0 THEN 0.0::DOUBLE END AS label FROM bars WINDOW w AS {_W}""",
    "labels_atr": f"""WITH {B5}, {p.numbered()}, t AS (SELECT *, {p.TR.format('b')} AS tr FROM b),
a AS (SELECT *, CASE WHEN rn >= 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) END * 0.5 AS lim,
      lead(close, 12) OVER {_W} - close AS d FROM t)
SELECT symbol, ts, CASE WHEN d > lim THEN 1.0::DOUBLE WHEN d < -lim THEN 0.0::DOUBLE END AS label FROM a""",
    "forward_return": f"""WITH {B5} SELECT symbol, ts,
  {p.r(f'coalesce((lead(close, 24) OVER {_W} - close) / nullif(close, 0), 0)', 'forward_return')} FROM bars""",
    "flat_dataset": f"""WITH {B5}, {_LR}, l AS (SELECT *, lead(close, 24) OVER {_W} AS later FROM rt)
SELECT symbol, ts, {p.r('r12', 'return_12bar')}, CASE WHEN later > close THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
  {p.r('coalesce((later - close) / nullif(close, 0), 0)', 'forward_return')}
FROM l WHERE later IS NOT NULL AND r1 IS NOT NULL AND r5 IS NOT NULL AND r12 IS NOT NULL""",
    "scaled_features": f"""WITH {B1}, {_LR}, l AS (SELECT *, lead(close, 6) OVER {_W} AS later FROM rt),
k AS (SELECT * FROM l WHERE later IS NOT NULL AND r1 IS NOT NULL AND r5 IS NOT NULL AND r12 IS NOT NULL)
SELECT symbol, ts, {', '.join(p.r(f'({c} - (SELECT avg({c}) FROM k)) / (SELECT stddev_pop({c}) FROM k)', n, 5)
                                for c, n in (('r1', 'return_1bar'), ('r5', 'return_5bar'), ('r12', 'return_12bar')))} FROM k""",
    "sequence_windows": f"""WITH {B5}, w AS (SELECT symbol, ts, row_number() OVER {_W} AS rn, close AS last_close,
  lag(close, 47) OVER {_W} AS first_close, sum(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 47 PRECEDING) AS volume_sum FROM bars)
SELECT symbol, ts, CAST(48 AS INTEGER) AS length, first_close, last_close, volume_sum FROM w WHERE rn >= 48""",
    "walk_forward_folds": f"""WITH {B5}, {_WF.format(src='bars')} SELECT symbol, ts, CAST(fold AS INTEGER) AS fold, role
  FROM wf WHERE role IS NOT NULL""",
    "cpcv_folds": _cpcv(),
    "fold_metrics": f"""WITH {_FOLDS} SELECT symbol, fold, trade_count, {p.rr(*_METRICS, digits=5)} FROM m""",
    "acceptance": f"""WITH {_FOLDS} SELECT symbol, fold, {_gate(_GATES)} AS meets_minimum, {_gate(_TARGETS)} AS meets_target,
  {', '.join(f'{_gate({k: v})} AS ok_{k}' for k, v in _GATES.items())} FROM m""",
    "drawdown": f"""WITH {B5}, r AS (SELECT symbol, ts, coalesce((lead(close) OVER {_W} - close) / (close + 1500), 0) AS r FROM bars),
c AS (SELECT *, sum(r) OVER {_W} AS a, exp(sum(ln(1 + r)) OVER {_W}) AS m FROM r)
SELECT symbol, ts, {p.r(f'max(a) OVER {_W} - a', 'additive')}, {p.r(f'(max(m) OVER {_W} - m) / max(m) OVER {_W}', 'compound')} FROM c""",
    "intraday_regime": f"""WITH RECURSIVE {_INTRADAY}
SELECT symbol, ts, istate AS intraday_state, {p.r('conf', 'intraday_conf')}, x AS atr_expanding FROM i""",
    "regime_gate": f"""WITH RECURSIVE {_GATE} SELECT symbol, ts, p AS proposed_state, cur AS state,
  {p.r('vc * CASE WHEN chg THEN 0.8 ELSE 1 END', 'confidence')},
  {p.r("round(CASE cur WHEN 'low_vol_trend' THEN 1.5 WHEN 'high_vol_trend' THEN 0.5 ELSE 1.0 END * bias * CASE WHEN chg THEN 0.7 ELSE 1 END, 3)", 'position_multiplier')},
  NOT (h BETWEEN 17 AND 21) AND vc >= 0.6 AS should_trade, vc < 0.6 AND NOT (h BETWEEN 17 AND 21) AS low,
  CAST(bias AS DOUBLE) AS session_bias FROM g""",
    "regime_records": f"""WITH RECURSIVE {_GATE} SELECT concat('regime.', g.symbol) AS topic, g.symbol, g.ts, cur AS state,
  {p.r('vc * CASE WHEN chg THEN 0.8 ELSE 1 END', 'confidence')},
  {p.r("round(CASE cur WHEN 'low_vol_trend' THEN 1.5 WHEN 'high_vol_trend' THEN 0.5 ELSE 1.0 END * bias * CASE WHEN chg THEN 0.7 ELSE 1 END, 3)", 'position_multiplier')},
  NOT (h BETWEEN 17 AND 21) AND vc >= 0.6 AS should_trade,
  coalesce(nullif(concat_ws('; ', CASE WHEN h BETWEEN 17 AND 21 THEN 'Late NY — declining liquidity' END,
    CASE WHEN vc < 0.6 THEN printf('Low confidence (%.2f < 0.60)', vc) END, CASE WHEN chg THEN 'Recent structural break detected' END), ''),
    cur || ' regime — ' || CASE WHEN h = 7 THEN 'London open — breakout expected' WHEN h BETWEEN 12 AND 15 THEN 'London-NY overlap — peak liquidity'
      WHEN h >= 22 OR h < 7 THEN 'Asian session — consolidation expected' ELSE 'Normal trading hours' END) AS reason,
  CASE WHEN isodow(g.ts) <= 3 THEN 0.9::DOUBLE END AS hmm_prob, {p.r('x.y', 'adx_value')}, x.x AS atr_expanding, CAST(bias AS DOUBLE) AS session_bias
FROM g JOIN x ON x.symbol = g.symbol AND x.ts = g.ts""",
    "signal_records": f"""WITH {B1}, u AS (SELECT symbol, ts, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS u FROM bars)
SELECT concat('signal.', symbol) AS topic, symbol, ts, CASE WHEN greatest(u, 1 - u) <= 0.55 THEN 'neutral' WHEN u > 1 - u THEN 'long' ELSE 'short' END AS direction,
  {p.r('CASE WHEN greatest(u, 1 - u) <= 0.55 THEN 0 ELSE greatest(u, 1 - u) END', 'confidence')}, '4h' AS predicted_horizon,
  CAST(NULL AS DOUBLE) AS base_prob, {p.r('u', 'ensemble_prob')}, {p.r('u', 'place')}, FALSE AS warmup_complete FROM u""",
    "regime_persistence": f"""WITH RECURSIVE {_PERSIST}
SELECT b.symbol, b.ts, b.proposed_state, st.cur AS state FROM b JOIN st USING (symbol, rn)""",
    "hmm_daily_features": f"""WITH {p.order_bars()}, {p.numbered()},
a AS (SELECT *, (close - pc) / nullif(pc, 0) AS r FROM b), l AS (SELECT *, lag(r) OVER {_W} AS lr FROM a),
m AS (SELECT *, count(r) OVER v AS n, stddev_samp(r) OVER v AS sd, covar_samp(r, lr) OVER k AS cv, var_samp(r) OVER k AS va,
      count(CASE WHEN r IS NOT NULL AND lr IS NOT NULL THEN 1 END) OVER k AS pairs, count(r) OVER k AS rs FROM l
      WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), k AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, ts, {p.r('sd', 'realized_vol')},
  {p.r('CASE WHEN pairs >= 10 AND rs >= 10 AND va <> 0 THEN greatest(-1, least(1, cv / va)) ELSE 0 END', 'autocorrelation')}
FROM m WHERE n >= 5 AND sd IS NOT NULL""",
    "trades_rule_signal": f"""WITH RECURSIVE {_T5} SELECT symbol, direction, entry_ts, {p.r('entry_price', 'entry_price')}, exit_ts, {p.r('exit_price', 'exit_price')}, bars_held,
  {p.r('pnl_pct', 'pnl_pct')}, regime_state FROM tr""",
    "signal_rule": f"""WITH {B1}, u AS (SELECT symbol, ts, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS u FROM bars)
SELECT symbol, ts, CASE WHEN greatest(u, 1 - u) <= 0.55 THEN 'neutral' WHEN u > 1 - u THEN 'long' ELSE 'short' END AS direction,
  {p.r('CASE WHEN greatest(u, 1 - u) <= 0.55 THEN 0 ELSE greatest(u, 1 - u) END', 'confidence')} FROM u""",
    "trade_grid": _grid(),
    "trade_metrics": f"""WITH RECURSIVE {_T5}, c AS (SELECT * FROM tr),
cu AS (SELECT *, exp(sum(ln(1 + pnl_pct / 100)) OVER (PARTITION BY symbol ORDER BY exit_ts)) AS eq FROM c),
dd AS (SELECT *, (max(eq) OVER (PARTITION BY symbol ORDER BY exit_ts) - eq) / max(eq) OVER (PARTITION BY symbol ORDER BY exit_ts) AS d FROM cu)
SELECT symbol, {p.r(_GROW, 'total_return')}, {p.r(_SHARPE, 'sharpe_ratio')},
  {p.r(f'avg(pnl_pct) / {_DOWN} * sqrt(252 * 6.5 / avg(bars_held))', 'sortino_ratio')},
  {p.r('least(sum(pnl_pct) FILTER (WHERE pnl_pct > 0) / abs(sum(pnl_pct) FILTER (WHERE pnl_pct <= 0)), 99.99)', 'profit_factor')},
  {p.r('100 * avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {p.r('100 * max(d)', 'max_drawdown')},
  count(*) AS trade_count, {p.r('avg(pnl_pct) FILTER (WHERE pnl_pct > 0)', 'avg_win')},
  {p.r('avg(pnl_pct) FILTER (WHERE pnl_pct <= 0)', 'avg_loss')}, {p.r('max(pnl_pct)', 'best_trade')},
  {p.r('min(pnl_pct)', 'worst_trade')} FROM dd GROUP BY symbol""",
    "metrics_by_regime": f"""WITH RECURSIVE {_T5}, c AS (SELECT * FROM tr) SELECT symbol, regime_state, count(*) AS trade_count,
  {p.r('100 * avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {p.r(_SHARPE, 'sharpe_ratio')},
  {p.r(_GROW, 'total_return')} FROM c GROUP BY symbol, regime_state""",
    "metrics_by_direction": f"""WITH RECURSIVE {_T5}, c AS (SELECT * FROM tr) SELECT symbol, direction, count(*) AS trade_count,
  count(*) FILTER (WHERE pnl_pct > 0) AS win_count, {p.r('100.0 * count(*) FILTER (WHERE pnl_pct > 0) / count(*)', 'win_rate')},
  {p.r('CASE WHEN sum(pnl_pct) FILTER (WHERE pnl_pct < 0) < 0 THEN least(coalesce(sum(pnl_pct) FILTER (WHERE pnl_pct > 0), 0) / abs(sum(pnl_pct) FILTER (WHERE pnl_pct < 0)), 99.99) WHEN max(pnl_pct) > 0 THEN 99.99 ELSE 0 END', 'profit_factor')},
  {p.r('sum(pnl_pct)', 'total_return')} FROM c GROUP BY symbol, direction""",
}
