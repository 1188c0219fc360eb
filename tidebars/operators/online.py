"""Online normalization of vectors: running statistics that winsorize, decay and react to data gaps.

The update is not linear, so rows of a series have to be followed one after the other. A task does
that for one block and all vector positions at once. A block starts far enough ahead of its rows for
its statistics to forget how they began, and that is then verified: where neighbouring blocks disagree at
their seams, each unbroken run of such blocks is followed again from the end before it, as one stream of rows
through one task. Later turns take more blocks after a run along, twice as many each time, so that the number of
turns grows with the logarithm of a series at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.sessions import session_class
from tidebars.operators.blocks import BLOCK, OWN, block_window, blocked, own_rows
from tidebars.schema import FEATURE_COLUMNS
from tidebars.session import materialize, spread

# fixed values: how each column is normalized, and the ranges of those rescaled
PASS, RESCALE, ZSCORE, VOLATILITY, LOG = "passthrough", "rescale", "zscore", "vol_adjust", "log_zscore"
CLASSES = {
    **{c: PASS for c in ("is_london_session", "is_ny_session", "is_overlap_session", "is_asian_session",
                         "is_month_turn", "bb_percent_b", "regime")},
    **{c: RESCALE for c in ("rsi_14", "rsi_7", "dxy_rsi_14", "hour_of_day", "day_of_week")},
    **{c: ZSCORE for c in ("macd_line", "macd_signal", "macd_histogram", "atr_14", "vix_change", "dxy_return_1h",
                           "open", "high", "low", "close")},
    **{c: VOLATILITY for c in ("return_1bar", "return_5bar", "return_12bar", "momentum_48")},
    **{c: LOG for c in ("bb_width", "rolling_volatility_20", "vix_level", "volume")},
}
RANGES = {"rsi_14": (0.0, 100.0), "rsi_7": (0.0, 100.0), "dxy_rsi_14": (0.0, 100.0), "hour_of_day": (0.0, 23.0),
          "day_of_week": (0.0, 6.0)}
ALPHA, MIN_SAMPLES, WINSOR, GAP_MINUTES, CLIP, VOL_FLOOR = 0.97, 20, 5.0, 180, 5.0, 1e-8

BURN_IN = 1400  # 0.97^1400 < 1e-18
SEAM_TOLERANCE = 1e-9


def column_classes(layout: Sequence[str], method: str) -> list[str]:
    """Class of every vector position; "online_zscore" turns all but passthrough positions into z-scores.

    In that method bar volume keeps its log.
    """
    if method not in ("online_zscore", "feature_specific"):
        raise ValueError("method must be online_zscore or feature_specific")
    out = []
    for name in layout:
        kind = CLASSES.get(name, ZSCORE)
        if method == "online_zscore" and kind != PASS and name in FEATURE_COLUMNS:
            kind = ZSCORE
        out.append(kind)
    return out


class _Stats:
    """Running mean and variance of every vector position."""

    def __init__(self, size: int):
        self.count, self.mean, self.var, self.last = 0, np.zeros(size), np.zeros(size), None

    def update(self, x: np.ndarray, at: np.datetime64) -> None:
        if self.count < MIN_SAMPLES:
            delta = x - self.mean
            self.mean = self.mean + delta / (self.count + 1)
            self.var = self.var + (delta * (x - self.mean) - self.var) / (self.count + 1)
        else:
            gap = (at - self.last) / np.timedelta64(1, "s") / 60
            keep = ALPHA * 0.5 if gap > GAP_MINUTES else ALPHA
            reach = WINSOR * self.deviation()
            near = np.where(reach > WINSOR * 1e-10, np.clip(x, self.mean - reach, self.mean + reach), x)
            self.mean = keep * self.mean + (1 - keep) * near
            self.var = keep * self.var + (1 - keep) * (near - self.mean) ** 2
        self.count, self.last = self.count + 1, at

    def deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.var, 0.0))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.count < MIN_SAMPLES:
            return x
        sd = self.deviation()
        flat = sd < 1e-10
        return np.where(flat, 0.0, (x - self.mean) / np.where(flat, 1.0, sd))

    def pack(self) -> list[float]:
        return [float(self.count), *self.mean, *self.var]

    @classmethod
    def unpack(cls, packed, last) -> "_Stats":
        size = (len(packed) - 1) // 2
        out = cls(size)
        out.count, out.last = int(packed[0]), last
        out.mean, out.var = np.asarray(packed[1: size + 1], float), np.asarray(packed[size + 1:], float)
        return out


def _logged(vectors: pd.Series, logs: np.ndarray) -> np.ndarray:
    values = np.stack([np.asarray(v, float) for v in vectors])
    values[:, logs] = np.log(np.maximum(values[:, logs], 1e-10))
    return values


def _follow(group: pd.DataFrame, logs: np.ndarray, ts: str) -> pd.DataFrame:
    """Scores of a block's own rows, with the statistics before the first and after the last of them."""
    group = group.sort_values(ts, kind="stable")
    if group[OWN].any():  # nothing after the last own row may enter
        group = group.iloc[: np.flatnonzero(group[OWN])[-1] + 1]
    values = _logged(group["_vec"], logs)
    times, own = group[ts].to_numpy(), group[OWN].to_numpy()
    stats = _Stats(values.shape[1])
    scores, begin = [], None
    for x, at, mine in zip(values, times, own):
        if mine and begin is None:
            begin = stats.pack()
        stats.update(x, at)
        if mine:
            scores.append(stats.score(x).tolist())
    kept = group[own].drop(columns=["_vec", OWN])
    blank = [None] * (len(kept) - 1)
    return kept.assign(_z=scores, _begin=[begin, *blank] if len(kept) else [],
                       _end=[*blank, stats.pack()] if len(kept) else [])


def _resume(keys: list[str], ts: str, logs: np.ndarray):
    """As ``_follow`` for sorted rows of runs: statistics go on from block to block and from batch to batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = block = stats = None
        for batch in batches:
            if batch.empty:
                continue
            values, times = _logged(batch["_vec"], logs), batch[ts].to_numpy()
            scores, begins, ends = [], [None] * len(batch), [None] * len(batch)
            names = [*keys, "_run", BLOCK]
            segment = batch.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1), len(batch)]
            for low, high in zip(cuts, cuts[1:]):
                first = batch.iloc[low]
                name, number = repr([first[n] for n in names[:-1]]), first[BLOCK]
                if name != here:
                    here, block, stats = name, None, _Stats.unpack(first["_given"], first["_given_ts"].to_datetime64())
                if number != block:
                    block, begins[low] = number, stats.pack()
                for x, at in zip(values[low:high], times[low:high]):
                    stats.update(x, at)
                    scores.append(stats.score(x).tolist())
                ends[high - 1] = stats.pack()  # of several in a block, the one with the highest count is the last
            yield batch[[*keys, BLOCK, ts]].assign(_z=scores, _begin=begins, _end=ends)
    return run


def _traced_schema(rows: DataFrame, keys: list[str], ts: str) -> str:
    types = dict(rows.dtypes)
    return ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"{BLOCK} long", f"`{ts}` timestamp",
                      "_z array<double>", "_begin array<double>", "_end array<double>"])


def _trace(rows: DataFrame, keys: list[str], ts: str, logs: np.ndarray) -> DataFrame:
    narrow = rows.select(*keys, BLOCK, ts, "_vec", OWN)
    return spread(narrow, *keys, BLOCK).groupBy(*keys, BLOCK).applyInPandas(
        lambda g: _follow(g, logs, ts), _traced_schema(rows, keys, ts))


def _retrace(rows: DataFrame, runs: DataFrame, keys: list[str], ts: str, logs: np.ndarray) -> DataFrame:
    """The blocks of ``runs`` anew, a run after the other in a task, of which it holds one batch at a time."""
    again = rows.filter(F.col(OWN)).join(runs, [*keys, BLOCK]).select(*keys, "_run", BLOCK, ts, "_vec", "_given", "_given_ts")
    return (spread(again, *keys, "_run").sortWithinPartitions(*keys, "_run", ts)
            .mapInPandas(_resume(keys, ts, logs), _traced_schema(rows, keys, ts)))


def _ends(traced: DataFrame, keys: list[str], ts: str, turn: int) -> DataFrame:
    """A row per block: the statistics at its begin and end, its last time, and the turn that found them."""
    return traced.groupBy(*keys, BLOCK).agg(F.max("_begin").alias("_begin"), F.max("_end").alias("_end"),
                                            F.max(ts).alias("_last")).withColumn("_turn", F.lit(turn))


def _runs(ends: DataFrame, keys: list[str], ahead: int) -> DataFrame:
    """Blocks whose start differs from the end of the block before them and up to ``ahead`` after such ones.

    ``_run`` is the first block of an unbroken run; that block has the statistics to begin with.
    """
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    linked = ends.withColumns({"_given": F.lag("_end").over(w), "_given_ts": F.lag("_last").over(w)})
    size = (F.size("_given") - 1) / 2
    # means are compared on the scale of the deviation, variances on their own
    worst = F.array_max(F.transform(F.slice("_given", F.lit(2), F.size("_given") - 1), lambda g, i: (
        F.abs(g - F.element_at("_begin", (i + 2).cast("int")))
        / (F.when(i < size, F.sqrt(F.greatest(F.element_at("_given", (i + 2 + size).cast("int")), F.lit(0.0)))
                  + F.abs(g)).otherwise(F.abs(g)) + 1e-12))))
    wrong = F.when(F.col("_given").isNotNull(), worst > SEAM_TOLERANCE).otherwise(False)
    marked = linked.withColumn("_wrong", wrong).withColumn("_redo", F.max("_wrong").over(w.rowsBetween(-ahead, 0)))
    starts = F.col("_redo") & ~F.coalesce(F.lag("_redo").over(w), F.lit(False))
    placed = marked.withColumn("_first", starts).withColumn(
        "_run", F.last(F.when(F.col("_first"), F.col(BLOCK)), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter("_redo").select(*keys, BLOCK, "_run", F.when(F.col("_first"), F.col("_given")).alias("_given"),
                                         F.when(F.col("_first"), F.col("_given_ts")).alias("_given_ts"))


def running_scores(rows: DataFrame, vector: str, logs: Sequence[bool], keys: Sequence[str], ts: str = "ts",
                   step: int | None = None, block_rows: int = 4096, burn_in: int = BURN_IN) -> DataFrame:
    """``rows`` plus ``_z``: every position of ``vector`` as a z-score under its running statistics.

    Every turn writes the blocks that it redoes and no others; which turn counts for a block is kept in a table
    of one row per block.
    """
    keys, mask = list(keys), np.asarray(logs, bool)
    cut = blocked(rows.select(*keys, ts, F.col(vector).alias("_vec")), back=burn_in, keys=keys, ts=ts, step=step,
                  rows=block_rows)
    traced = [materialize(_trace(cut, keys, ts, mask))]
    ends = materialize(_ends(traced[0], keys, ts, 0))
    while True:
        turn = len(traced)
        runs = materialize(_runs(ends, keys, 2 ** (turn - 1) - 1))
        if runs.isEmpty():
            break
        traced.append(materialize(_retrace(cut, runs, keys, ts, mask)))
        fresh = _ends(traced[-1], keys, ts, turn)
        ends = materialize(ends.join(runs.select(*keys, BLOCK), [*keys, BLOCK], "left_anti").unionByName(fresh))
    scores = traced[0].select(*keys, BLOCK, ts, "_z")
    if len(traced) > 1:
        parts = [t.select(*keys, BLOCK, ts, "_z", F.lit(i).alias("_turn")) for i, t in enumerate(traced)]
        scores = reduce(DataFrame.unionByName, parts).join(ends.select(*keys, BLOCK, "_turn"), [*keys, BLOCK, "_turn"])
    return rows.join(scores.select(*keys, ts, "_z"), [*keys, ts])


def normalize_vectors(
    rows: DataFrame, layout: Sequence[str], method: str = "online_zscore", vector: str = "observation",
    volatility: str | None = None, session_aware: bool = False, keys: Sequence[str] = ("symbol",), ts: str = "ts",
    step: int | None = None, name: str = "normalized",
) -> DataFrame:
    """Normalize vectors position by position and clip them to [-5, 5].

    ``volatility`` names a column whose value at the row before scales the returns; without one, or
    where it is (nearly) zero, returns stay as they are. ``session_aware`` keeps separate statistics
    per trading session.
    """
    classes = column_classes(layout, method)
    keys = list(keys)
    base = rows
    if volatility:
        base = own_rows(blocked(rows, back=1, keys=keys, ts=ts, step=step).withColumn(
            "_vol", F.lag(volatility).over(block_window(keys, ts))))
    else:
        base = base.withColumn("_vol", F.lit(None).cast("double"))
    stat_keys = keys
    if session_aware:
        base, stat_keys = base.withColumn("_session", session_class(ts)), [*keys, "_session"]
    scored = running_scores(base, vector, [c == LOG for c in classes], stat_keys, ts, step)
    low = F.array(*[F.lit(RANGES.get(n, (0.0, 1.0))[0]) for n in layout])
    span = F.array(*[F.lit(RANGES[n][1] - RANGES[n][0] if n in RANGES else 1.0) for n in layout])
    kind = F.array(*[F.lit(c) for c in classes])

    def position(x: Column, i: Column) -> Column:
        k = F.get(kind, i)
        value = (
            F.when(k.isin(ZSCORE, LOG), F.get("_z", i))
            .when(k == RESCALE, (x - F.get(low, i)) / F.get(span, i))
            .when((k == VOLATILITY) & (F.col("_vol") > VOL_FLOOR), x / F.nullif(F.col("_vol"), F.lit(0.0)))
            .otherwise(x))
        return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), value))

    return scored.withColumn(name, F.transform(vector, position)).drop("_z", "_vol", "_session")
