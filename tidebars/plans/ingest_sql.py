"""Comparison SQL of ``ingest_queries``."""

from __future__ import annotations

from tidebars.plans import sql_parts as p
from tidebars.plans.series_sql import B1, B5, SQL as SERIES_SQL
from tidebars.sources.tables import EXPORT_COLUMNS

_RAW = """raw AS (
  SELECT l_shipdate AS ts, l_orderkey + l_linenumber AS n, l_extendedprice AS price,
    CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE l_extendedprice END AS open,
    CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN l_extendedprice * 0.5::DOUBLE
         ELSE l_extendedprice * 1.25::DOUBLE END AS high,
    CASE WHEN (l_orderkey + l_linenumber) % 13 <> 0 THEN l_extendedprice * 0.75::DOUBLE END AS low,
    l_extendedprice AS close,
    CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN -l_quantity ELSE l_quantity END AS volume,
    CASE l_returnflag WHEN 'A' THEN 'XAUUSD' WHEN 'R' THEN 'OTHER' ELSE 'XAUUSD' END AS symbol,
    CASE WHEN l_linestatus = 'F' THEN '5m' ELSE '1m' END AS timeframe
  FROM lineitem)"""

_NOW = "TIMESTAMP '1997-06-01'"
_TIME = {
    "future": f"WHEN epoch_us({_NOW}) - epoch_us(ts) < -5000000 THEN 'timestamp_not_future|timestamp'",
    "stale": f"WHEN epoch_us({_NOW}) - epoch_us(ts) > 120000000 THEN 'timestamp_not_stale|timestamp'",
}
_REST = """WHEN symbol = 'XAUUSD' AND open IS NULL THEN 'decimal_conversion|open'
  WHEN symbol = 'XAUUSD' AND (open < 1000 OR open > 10000) THEN 'price_bounds|open'
  WHEN symbol = 'XAUUSD' AND (high < 1000 OR high > 10000) THEN 'price_bounds|high'
  WHEN symbol = 'XAUUSD' AND low IS NULL THEN 'not_none|low'
  WHEN symbol = 'XAUUSD' AND (low < 1000 OR low > 10000) THEN 'price_bounds|low'
  WHEN symbol = 'XAUUSD' AND (close < 1000 OR close > 10000) THEN 'price_bounds|close'
  WHEN open IS NULL THEN 'decimal_conversion|open' WHEN low IS NULL THEN 'not_none|low'
  WHEN low > high THEN 'ohlc_consistency|low' WHEN open < low OR open > high THEN 'ohlc_consistency|open'
  WHEN close < low OR close > high THEN 'ohlc_consistency|close'
  WHEN volume < 0 THEN 'volume_non_negative|volume' ELSE 'accepted|' END"""


def _reasons(*first: str) -> str:
    return f"""WITH {_RAW}, c AS (SELECT symbol, CASE {' '.join(_TIME[f] for f in first)} {_REST} AS k FROM raw)
SELECT symbol, split_part(k, '|', 1) AS rule, split_part(k, '|', 2) AS field, count(*) AS rows FROM c GROUP BY ALL"""


_F = SERIES_SQL["feature_table"]
_BATCHES = f"""{B5}, fetched AS (
  SELECT symbol, ts, close + k AS close, CASE WHEN hour(ts) = 3 THEN NULL ELSE volume END AS volume, k
  FROM bars, (VALUES (0), (1), (2)) t(k) WHERE minute(ts) >= 50 OR k = 1),
picked AS (SELECT symbol, ts, arg_min(close, k) AS close, any_value(volume) AS volume, count(*) - 1 AS duplicates
           FROM fetched GROUP BY symbol, ts)"""


def _with_features(tail: str) -> str:
    head, select = _F[: _F.index("\nSELECT b.symbol, '1h'")], _F[_F.index("\nSELECT b.symbol, '1h'"):]
    return f"{head}, ft AS ({select}) {tail}"


SQL = {
    "validate_default": _reasons("future"),
    "validate_live": _reasons("future", "stale"),
    "validate_historical": _reasons(),
    "normalized_bars": f"""WITH {_RAW}, c AS (SELECT *, CASE {_REST} AS k FROM raw)
SELECT symbol, timeframe, count(*) AS rows, {p.r('min(low)', 'low', 4)}, {p.r('max(high)', 'high', 4)},
  {p.r('sum(volume)', 'volume', 4)} FROM c WHERE k = 'accepted|' GROUP BY symbol, timeframe""",
    "unknown_symbols": f"WITH {B5} SELECT upper(symbol) AS symbol, count(*) AS rows FROM bars GROUP BY 1",
    "null_profile": _with_features("SELECT feature, " + p.r("s", "null_share") + """,
  CASE WHEN s = 1 THEN 'empty' WHEN s > 0.5 THEN 'sparse' ELSE 'ok' END AS status FROM ("""
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM ft"
                             for c in p.INPUTS) + ")"),
    "load_summary": f"""WITH {B1}, {p.numbered()} SELECT symbol, '1h' AS timeframe, count(*) AS bars, min(ts) AS first_ts,
  max(ts) AS last_ts, count(*) AS features, count(*) FILTER (WHERE rn >= 49) AS warm FROM b GROUP BY symbol""",
    "dedupe_batches": f"""WITH {_BATCHES} SELECT symbol, ts, {p.r('close', 'close')}, {p.r('volume', 'volume')},
  duplicates FROM picked""",
    "dedupe_stats": f"""WITH {_BATCHES} SELECT count(*) AS rows_loaded, CAST(sum(duplicates) AS BIGINT) AS rows_skipped,
  min(ts) AS start_date, max(ts) AS end_date FROM picked""",
    "latest_bar": f"""WITH {B5} SELECT symbol, '5m' AS timeframe, ts, open, high, low, close, volume FROM bars
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
    "range_scan_series": f"""WITH {B5} SELECT symbol, ts, open, high, low, close, volume FROM bars
  WHERE symbol = 'click' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
    "latest_state": f"""WITH {B5}, l AS (SELECT symbol, '5m' AS timeframe, max(ts) AS ts, arg_max(close, ts) AS close
  FROM bars GROUP BY symbol)
SELECT * FROM l WHERE ts > (SELECT max(ts) FROM bars) - INTERVAL '1 hour' AND symbol <> 'click'""",
    "feature_export": _with_features("SELECT " + ", ".join(
        "ts AS timestamp" if c == "timestamp" else c for c in EXPORT_COLUMNS) + " FROM ft"),
    "datetime_formats": """SELECT o_orderkey, CASE WHEN o_orderkey % 12 < 11 THEN o_orderdate END AS ts,
  CASE WHEN o_orderkey % 12 < 11 THEN 'loaded' ELSE 'malformed' END AS outcome FROM orders""",
    "csv_load": """SELECT count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS rows_loaded, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS rows_skipped,
  min(o_orderdate) FILTER (WHERE o_orderkey % 50 <> 0) AS start_date, max(o_orderdate) FILTER (WHERE o_orderkey % 50 <> 0) AS end_date,
  count(*) FILTER (WHERE o_orderkey % 50 = 0) AS n, 'no known date format: soon' AS error,
  count(*) FILTER (WHERE o_orderkey % 50 <> 0 AND o_orderkey % 3 = 0) AS volumes,
  count(DISTINCT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END) AS days FROM orders""",
    "table_upsert": f"""WITH {B1} SELECT symbol, '1h' AS timeframe, ts, CASE WHEN day(ts) >= 15 THEN close + 1 ELSE close END AS close,
  volume, CAST(NULL AS BOOLEAN) AS is_complete FROM bars""",
    "bar_records": f"""WITH {B1} SELECT concat('bar.', symbol, '.1h') AS topic, symbol, ts, open, high, low, close,
  volume, TRUE AS is_complete FROM bars""",
}
SQL["feature_records"] = SQL["feature_export"]
