"""Splitting series into blocks, so that no series ever has to fit into one task.

A series (one symbol and timeframe) may hold a large share of all rows, so no operator here opens a
window over a whole series. ``blocked`` cuts every series into runs of about ``rows`` bars and
copies the few bars a look-back (or look-ahead) needs from the neighbouring run. All windows are
then partitioned by (series, block), and ``own_rows`` drops the copies again.

The cut points come from a small count table (one row per 256 bars). Catalyst broadcasts it when it
is small and shuffles it when it is not; the bars themselves are shuffled once by (series, block).

``carry_last`` is the counterpart for look-backs without a bound ("last value seen"): a window per
block, plus one value per block handed on through a table that has one row per block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebars.schema import SERIES, TS, timeframe_seconds

FINE = 256
ROWS = 4096
HALO = 1024
MOST_POWER = 680  # of e, half the span of powers in a block: e^680 is a double

BLOCK = "_blk"
OWN = "_own"
ROW = "rn"
HELPERS = (BLOCK, OWN, ROW)


def _step(keys: Sequence[str], step: int | None) -> Column:
    if step is not None:
        return F.lit(step).cast("long")
    if "timeframe" not in keys:
        raise ValueError("give step (seconds between rows) when the keys hold no timeframe")
    return timeframe_seconds("timeframe")


def time_bucket(bars: int, keys: Sequence[str] = SERIES, ts: str = TS, step: int | None = None) -> Column:
    """Number of the time slice of ``bars`` bar lengths that a row falls into."""
    return F.floor(F.unix_seconds(F.col(ts)) / (_step(keys, step) * bars)).cast("long")


def block_window(keys: Sequence[str] = SERIES, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(ts)


def blocked(
    df: DataFrame,
    back: int = 0,
    fwd: int = 0,
    keys: Sequence[str] = SERIES,
    ts: str = TS,
    step: int | None = None,
    rows: int = ROWS,
    total: str | None = None,
) -> DataFrame:
    """Add the block number, the 1-based row number in the series and the own-row mark.

    ``total`` names a further column for the number of rows in the series. Every block holds at least ``back`` earlier and ``fwd`` later rows of the series where these
    exist. Times must be unique in a series, which bars are by their key, and no closer than its bar length: the
    job fails where 256 bar lengths hold more than 256 rows.
    """
    if max(back, fwd) + FINE > rows:
        raise ValueError(f"look-back and look-ahead must stay below {rows - FINE} rows")
    keys = list(keys)
    fine, off, cnt, own = F.col("_fine"), F.col("_off"), F.col("_cnt"), F.col("_mine")
    sliced = df.withColumn("_fine", time_bucket(FINE, keys, ts, step))
    counts = sliced.groupBy(*keys, "_fine").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy("_fine").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    length = [F.sum(cnt).over(whole).alias(total)] if total else []
    cuts = (
        counts.withColumn("_cnt", F.when(cnt > FINE, F.raise_error(F.lit(
            f"rows are closer than their bar length: more than {FINE} of them in {FINE} bars"))).otherwise(cnt))
        .withColumn("_off", F.coalesce(F.sum(cnt).over(before), F.lit(0)))
        .withColumn("_mine", F.floor(off / rows).cast("long"))
        .select(
            *keys,
            "_fine",
            "_off",
            "_mine",
            *length,
            F.array_compact(F.array(
                own,
                *([F.when(((own + 1) * rows - (off + cnt)) < back, own + 1)] if back else []),
                *([F.when((own > 0) & (off - own * rows - (FINE - 1) < fwd), own - 1)] if fwd else []),
            )).alias("_blks"),
        )
    )
    w = block_window(keys, ts)
    return (
        sliced.join(cuts, [*keys, "_fine"])
        .withColumn(BLOCK, F.explode("_blks"))
        .withColumn(OWN, F.col(BLOCK) == own)
        .withColumn(ROW, (F.first("_off").over(w) + F.row_number().over(w)).cast("long"))
        .drop("_fine", "_off", "_mine", "_blks")
    )


def own_rows(df: DataFrame, keep_row: bool = False) -> DataFrame:
    """Drop the copied rows and the helper columns."""
    drop = [c for c in HELPERS if not (keep_row and c == ROW)]
    return df.filter(F.col(OWN)).drop(*drop)


def number_rows(df: DataFrame, keys: Sequence[str] = SERIES, ts: str = TS, step: int | None = None,
                name: str = ROW) -> DataFrame:
    """1-based position of every row in its series, without a window over the series."""
    out = own_rows(blocked(df, 0, 0, keys, ts, step), keep_row=True)
    return out.withColumnRenamed(ROW, name) if name != ROW else out


def run_stages(df: DataFrame, *stage_lists: list[dict[str, Column]]) -> DataFrame:
    """Apply several column programs side by side, so that equal windows share one pass."""
    for depth in range(max(len(s) for s in stage_lists)):
        columns: dict[str, Column] = {}
        for stages in stage_lists:
            if depth < len(stages):
                columns.update(stages[depth])
        df = df.withColumns(columns)
    return df.drop(*[c for c in df.columns if c.startswith("_t_")])


def hand_on(df: DataFrame, columns: dict[str, str], keys: Sequence[str], part: str, order: str) -> DataFrame:
    """Fill nulls of each source column from the last value of an earlier part of its series.

    ``columns`` maps source to output name. Within a part the rows must already carry the last
    value seen there (or null); what crosses the border is one row per part.
    """
    keys = list(keys)
    ends = df.groupBy(*keys, part).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_e_{c}") for c in columns
    ])
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, part, *[F.last(f"_e_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns]
    )
    joined = df.join(carry, [*keys, part], "left")
    filled = joined.withColumns({out: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c, out in columns.items()})
    return filled.drop(*[f"_c_{c}" for c in columns])


def carry_last(
    df: DataFrame,
    columns: dict[str, str],
    keys: Sequence[str] = SERIES,
    ts: str = TS,
    step: int | None = None,
    bars: int = ROWS,
    order: str | None = None,
) -> DataFrame:
    """Last non-null value up to and including each row: ``columns`` maps source to output name.

    ``order`` names a finer order than ``ts`` where times repeat within a series.
    """
    part, order = "_slice", order or ts
    w = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(part, time_bucket(bars, keys, ts, step)).withColumns(
        {f"_l_{c}": F.last(c, ignorenulls=True).over(w) for c in columns}
    )
    out = hand_on(local, {f"_l_{c}": name for c, name in columns.items()}, keys, part, order)
    return out.drop(part, *[f"_l_{c}" for c in columns])


def settling_rows(q: float) -> int:
    """Rows after which a recurrence has forgotten what came before, as far as a double can show."""
    return math.ceil(41.5 / -math.log(q)) if q > 0 else 1


def decay_plan(*factors: float, spare: int = 64) -> tuple[int, int]:
    """(back, rows) of blocks in which recurrences with these factors can be scanned side by side.

    The slowest factor asks for the halo, the fastest bounds the block, as its powers must stay doubles. The
    usual blocks are kept where they serve; where nothing does, that is an error.
    """
    used = [q for q in factors if q > 0]
    if any(not 0 <= q < 1 for q in factors):
        raise ValueError(f"smoothing factors must lie in [0, 1), got {factors}")
    if not used:
        return HALO, ROWS
    back, most = settling_rows(max(used)) + spare, math.floor(2 * MOST_POWER / -math.log(min(used))) - 2 * FINE
    if back <= HALO and HALO + ROWS <= most:
        return HALO, ROWS
    rows = min(max(ROWS, 2 * back), most - back)
    if rows < back + FINE:
        raise ValueError(f"factors {max(used)} and {min(used)} are too far apart for one block; scan them separately")
    return back, rows


def decay_scan(term: Column, q: float, keys: Sequence[str] = SERIES, ts: str = TS, rows: int = ROWS,
               back: int = HALO) -> Column:
    """Linear recurrence ``y[n] = q*y[n-1] + term[n]`` inside a block.

    One running sum: ``q^k * sum(term * q^-k)``, with ``k`` centred on the block so that the powers
    stay inside the double range. Rows before the halo would add less than ``q^back``, which must be
    below double precision; ``decay_plan`` finds block and halo for a factor.
    """
    if q == 0:
        return F.coalesce(term, F.lit(0.0))
    if q ** back > 1e-17 or -math.log(q) * (rows + back + 2 * FINE) / 2 > MOST_POWER:
        raise ValueError(f"a factor of {q} needs other blocks than {rows} rows after {back}; see decay_plan")
    k = (F.col(ROW) - (F.col(BLOCK) * rows + (rows - back) // 2)).cast("double")
    w = block_window(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.coalesce(term, F.lit(0.0)) * F.pow(F.lit(q), -k)).over(w) * F.pow(F.lit(q), k)
