"""Comparison SQL of ``stream_queries``: a drained stream equals the batch result, without a session end as far as its watermark went."""

from __future__ import annotations

from tidebars.plans import sql_parts as p
from tidebars.plans.series_sql import B1, SQL as SERIES_SQL, _coarse

SQL = {
    # the watermark stands a minute (ticks) or ten seconds (live bars, which begin on a multiple of five) behind the last time
    "stream_bars": f"""WITH {B1} SELECT symbol, '1h' AS timeframe, ts, open, high, low, close, volume, TRUE AS is_complete
FROM bars""",
    "stream_flush": f"""WITH {B1} SELECT symbol, '1h' AS timeframe, ts, open, high, low, close, volume
FROM bars WHERE ts + INTERVAL '1 hour' > (SELECT max(ts) - INTERVAL '1 minute' FROM events)""",
    "stream_live": f"""WITH {B1}, f AS (SELECT event_type AS symbol, time_bucket(INTERVAL '5 seconds', ts) AS b FROM events GROUP BY 1, 2),
n AS (SELECT symbol, time_bucket(INTERVAL '1 hour', b) AS ts, count(*) AS n FROM f GROUP BY 1, 2)
SELECT bars.symbol, '1h' AS timeframe, bars.ts, open, high, low, close, volume, n = 720 AS is_complete FROM bars JOIN n USING (symbol, ts)
WHERE bars.ts + INTERVAL '1 hour' <= (SELECT max(b) - INTERVAL '10 seconds' FROM f)""",
    "stream_resample_early": f"""WITH {B1}, c AS ({_coarse('bars', "INTERVAL '4 hours'", 4, '4h')}),
l AS (SELECT symbol, max(ts) AS last_ts FROM c GROUP BY symbol)
SELECT c.* FROM c JOIN l USING (symbol) WHERE ts < last_ts OR is_complete""",
    "stream_features": SERIES_SQL["feature_table"],
    "stream_latest": f"""WITH {p.event_bars('bars', p.FIVE)} SELECT symbol, '5m' AS timeframe, max(ts) AS ts,
  arg_max(close, ts) AS close, arg_max(volume, ts) AS volume FROM bars GROUP BY symbol""",
    "stream_topics": f"""WITH {B1} SELECT 'all' AS subscriber, concat('bar.', symbol, '.1h') AS topic, count(*) AS records
FROM bars GROUP BY symbol UNION ALL SELECT 'clicks', 'bar.click.1h', count(*) FROM bars WHERE symbol = 'click'""",
}
