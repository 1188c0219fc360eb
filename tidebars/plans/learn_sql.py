"""Comparison SQL of ``learn_queries`` (fitted models have none)."""

from __future__ import annotations

from tidebars.plans import sql_parts as p
from tidebars.plans.model_sql import _LR
from tidebars.plans.series_sql import B1

_W = "(PARTITION BY symbol ORDER BY ts)"
_REPORT = f"""{B1}, {_LR},
sg AS (SELECT symbol, ts, rn, open + 500 AS open, close + 500 AS close, rn >= 49 AS warm,
  CASE WHEN r5 < -1 THEN 'long' WHEN r5 > 1 THEN 'short' END AS side, lead(open + 500) OVER {_W} AS nopen FROM rt),
cd AS (SELECT *, side IS NOT NULL AND nopen > 0 AND warm AS cand FROM sg),
hold AS (
  SELECT symbol, rn, CASE WHEN cand THEN 6 ELSE 0 END AS left_after, cand AS entered, TRUE AS flat, warm FROM cd WHERE rn = 1
  UNION ALL
  SELECT cd.symbol, cd.rn, CASE WHEN h.left_after <= 1 AND cd.cand THEN 6 ELSE greatest(h.left_after - 1, 0) END,
    h.left_after <= 1 AND cd.cand, h.left_after <= 1, cd.warm FROM hold h JOIN cd ON cd.symbol = h.symbol AND cd.rn = h.rn + 1),
tr AS (SELECT e.symbol, x.ts AS exit_ts, e.nopen, CAST(x.rn - e.rn AS INTEGER) AS bars_held,
    100 * ((CASE WHEN e.side = 'long' THEN x.close - e.nopen ELSE e.nopen - x.close END) / e.nopen - 0.3 / e.nopen) AS pl
  FROM hold h JOIN cd e ON e.symbol = h.symbol AND e.rn = h.rn
    JOIN cd x ON x.symbol = e.symbol AND x.rn = least(e.rn + 6, (SELECT max(rn) FROM cd m WHERE m.symbol = e.symbol)) WHERE h.entered),
mt AS (SELECT symbol, count(*) AS trade_count, avg(pl) / stddev_samp(pl) * sqrt(252 * 6.5 / avg(bars_held)) AS sharpe,
    avg(pl) / stddev_samp(pl) FILTER (WHERE pl < 0) * sqrt(252 * 6.5 / avg(bars_held)) AS sortino,
    sum(pl) FILTER (WHERE pl > 0) / abs(sum(pl) FILTER (WHERE pl <= 0)) AS pf, 100 * avg(CASE WHEN pl > 0 THEN 1.0 ELSE 0.0 END) AS wr
  FROM tr GROUP BY symbol)"""

_NODES = """(VALUES (0, 1.0, 0, 0, 0.1, 1, 2, 0.0), (0, 1.0, 1, 1, 1.5, 3, 4, 0.0), (0, 1.0, 2, -1, NULL, -1, -1, -0.4), (0, 1.0, 3, -1, NULL, -1, -1, 0.5),
  (0, 1.0, 4, 3, 11.5, 5, 6, 0.0), (0, 1.0, 5, -1, NULL, -1, -1, 0.25), (0, 1.0, 6, -1, NULL, -1, -1, -0.125),
  (1, 0.5, 0, 2, 60.0, 1, 2, 0.0), (1, 0.5, 1, 0, -0.3, 3, 4, 0.0), (1, 0.5, 2, 2, 110.0, 5, 6, 0.0), (1, 0.5, 3, -1, NULL, -1, -1, 0.75),
  (1, 0.5, 4, -1, NULL, -1, -1, 0.1), (1, 0.5, 5, -1, NULL, -1, -1, -0.2), (1, 0.5, 6, -1, NULL, -1, -1, -0.9),
  (2, 0.25, 0, 3, 6.5, 1, 2, 0.0), (2, 0.25, 1, -1, NULL, -1, -1, 0.6), (2, 0.25, 2, 1, 3.5, 3, 4, 0.0), (2, 0.25, 3, -1, NULL, -1, -1, -0.3),
  (2, 0.25, 4, -1, NULL, -1, -1, 0.3)) v(tree, weight, node, feature, threshold, l, r, value)"""
#: Every row with each input set to its mean in turn (variant -1: none), walked down every tree.
_WALK = f"""{B1}, {_LR}, nodes AS (SELECT tree, weight::DOUBLE AS weight, node, feature, threshold::DOUBLE AS threshold, l, r, value::DOUBLE AS value FROM {_NODES}),
x AS (SELECT symbol, ts, i, [CASE WHEN i = 0 THEN 0.0 ELSE coalesce(r1, 0) END, CASE WHEN i = 1 THEN 2.0 ELSE volume END,
  CASE WHEN i = 2 THEN 80.0 ELSE close END, CASE WHEN i = 3 THEN 12.0 ELSE hour(ts)::DOUBLE END] AS v FROM rt, (SELECT unnest(range(-1, 4)) AS i)),
walk AS (
  SELECT symbol, ts, i, v, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT symbol, ts, i, v, w.tree, CASE WHEN v[n.feature + 1] <= n.threshold THEN n.l ELSE n.r END
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature >= 0),
p AS (SELECT symbol, ts, i, 1 / (1 + exp(-2 * sum(value * weight ORDER BY w.tree))) AS p
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature < 0 GROUP BY symbol, ts, i)"""

SQL = {
    "tree_scores": f"""WITH RECURSIVE {_WALK} SELECT symbol, ts, {p.r('p', 'prob_long')} FROM p WHERE i = -1""",
    "tree_attributions": f"""WITH RECURSIVE {_WALK},
e AS (SELECT a.symbol, a.ts, b.i, a.p - b.p AS effect, row_number() OVER (PARTITION BY a.symbol, a.ts ORDER BY round(abs(a.p - b.p), 12) DESC, b.i) AS k
  FROM p a JOIN p b ON a.symbol = b.symbol AND a.ts = b.ts AND a.i = -1 AND b.i >= 0)
SELECT symbol, ts, ['return_1bar', 'volume', 'close', 'hour'][i + 1] AS feature, {p.r('effect', 'effect')} FROM e WHERE k <= 2""",
    "backtest_report": f"""WITH RECURSIVE {_REPORT}, sp AS (SELECT symbol, count(*) AS bars_processed, min(ts) AS start_date,
  max(ts) AS end_date FROM bars GROUP BY symbol), sn AS (SELECT symbol, count(*) AS signals_generated FROM hold WHERE flat AND warm GROUP BY symbol)
SELECT symbol, bars_processed, start_date, end_date, signals_generated, trade_count,
  round(sharpe, 2) >= 1.0 AND round(sortino, 2) >= 1.5 AND round(pf, 2) >= 1.3 AND round(wr, 1) >= 40 AS meets_minimum
FROM sp JOIN sn USING (symbol) JOIN mt USING (symbol)""",
    "overlap_check": f"""WITH {p.order_bars()}, s AS (SELECT symbol, year(ts) AS year, min(ts) AS start, max(ts) AS "end" FROM bars GROUP BY 1, 2)
SELECT *, start <= TIMESTAMP '1998-02-01' AND "end" >= TIMESTAMP '1996-05-01' AS overlaps FROM s""",
}
