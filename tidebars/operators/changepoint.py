"""Structural breaks in the last returns of every bar.

Each bar has its own window of at most 100 past returns. The returns of a block, with the 100 before it, go to a task
in one array; windows are views of it, segmented a batch at a time, and only their breaks leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import BLOCK, OWN, ROW, block_window, blocked, carry_last, own_rows
from tidebars.schema import SERIES
from tidebars.session import spread

# fixed values: segmentation settings
WINDOW, MIN_SIZE, PENALTY, GRID, RECENT = 100, 10, 3.0, 5, 20
_BATCH = 64
_BLOCK = 512  # returns of a block, which as many segmentations follow


def segment(x: np.ndarray, min_size: int = MIN_SIZE, penalty: float = PENALTY, grid: int = GRID) -> list[list[int]]:
    """Optimal penalized segmentation of every row of ``x`` (rows, n) under a Gaussian-kernel cost.

    The kernel width is the median squared distance of the row. Breaks lie on multiples of ``grid``
    and segments hold at least ``min_size`` values.
    """
    rows, n = x.shape
    dist = (x[:, :, None] - x[:, None, :]) ** 2
    median = np.median(dist[:, *np.triu_indices(n, 1)], axis=1)
    dist /= np.where(median > 0, median, 1.0)[:, None, None]
    gram = np.exp(-np.clip(dist, 1e-2, 1e2, out=dist))
    gram[:, np.arange(n), np.arange(n)] = 1.0
    # breaks lie on the grid, so sums over grid cells are all the costs need
    cells = -(-n // grid)
    member = (np.arange(n)[:, None] // grid == np.arange(cells)).astype(float)
    total = np.zeros((rows, cells + 1, cells + 1))
    total[:, 1:, 1:] = (member.T @ gram @ member).cumsum(axis=1).cumsum(axis=2)
    ends = [k for k in range(grid, n, grid) if k >= min_size] + [n]
    best = {0: np.zeros(rows)}
    came: dict[int, np.ndarray] = {}
    for end in ends:
        options = [t for t in best if end - t >= min_size]
        e = -(-end // grid)
        costs = np.stack([
            best[t] + penalty + (end - t)
            - (total[:, e, e] - 2 * total[:, t // grid, e] + total[:, t // grid, t // grid]) / (end - t)
            for t in options
        ])
        pick = costs.argmin(axis=0)
        best[end] = costs[pick, np.arange(rows)]
        came[end] = np.asarray(options)[pick]
    breaks: list[list[int]] = []
    for r in range(rows):
        at, found = n, []
        while at > 0:
            at = int(came[at][r])
            if at > 0:
                found.append(at)
        breaks.append(found[::-1])
    return breaks


def trailing_breaks(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Break positions in the windows of ``sizes`` values that end with the places ``ends``; none below two minimal segments."""
    found: list[list[int]] = [[] for _ in range(len(ends))]
    for n in np.unique(sizes[sizes >= 2 * MIN_SIZE]):
        windows = np.lib.stride_tricks.sliding_window_view(values, n)
        where = np.flatnonzero(sizes == n)
        for lo in range(0, len(where), _BATCH):
            part = where[lo: lo + _BATCH]
            for i, points in zip(part, segment(windows[ends[part] - n + 1])):
                found[i] = points
    return found


def has_recent_change(points: Column, length: Column, lookback: int = RECENT) -> Column:
    return F.exists(points, lambda p: p > length - lookback)


def _breaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block in batch.itertuples(index=False):
            _, _, _, row, at, values, own = block
            sizes = np.minimum(np.asarray(row), WINDOW)
            mine = np.flatnonzero(np.asarray(own) & (sizes >= 2 * MIN_SIZE))
            if not len(mine):
                continue
            found = trailing_breaks(np.asarray(values, float), mine, sizes[mine])
            recent = [any(p > n - RECENT for p in points) for n, points in zip(sizes[mine], found)]
            yield pd.DataFrame({"symbol": block.symbol, "timeframe": block.timeframe, "_at": np.asarray(at)[mine],
                                "change_points": found, "recent_change": recent})


def with_change_points(bars: DataFrame) -> DataFrame:
    """``change_points`` of the trailing returns and ``recent_change`` at every bar.

    Returns from a price at or below zero are not counted, so the returns that exist form their own
    series; rows without one keep what the row before had.
    """
    previous = F.lag("close").over(block_window())
    returns = own_rows(blocked(bars.select(*SERIES, "ts", "close"), back=1).withColumn(
        "_r", F.when(previous > 0, (F.col("close") - previous) / F.nullif(previous, F.lit(0.0)))))
    cut = blocked(returns.filter(F.col("_r").isNotNull()), back=WINDOW, rows=_BLOCK)
    packed = cut.groupBy(*SERIES, BLOCK).agg(F.sort_array(F.collect_list(F.struct(
        F.col(ROW).alias("row"), F.unix_micros("ts").alias("at"), F.col("_r").alias("r"), F.col(OWN).alias("own")))).alias("_rows"))
    # the segmentation is the dear part: share the blocks out evenly, whatever their bytes
    shared = spread(packed.select(*SERIES, BLOCK, *[F.col(f"_rows.{c}").alias(f"_{c}") for c in ("row", "at", "r", "own")]), *SERIES, BLOCK)
    points = shared.mapInPandas(_breaks, "symbol string, timeframe string, _at long, change_points array<int>, recent_change boolean").select(
        *SERIES, F.timestamp_micros("_at").alias("ts"), F.struct("change_points", "recent_change").alias("_c"))
    joined = bars.join(points, [*SERIES, "ts"], "left")
    filled = carry_last(joined, {"_c": "_last"}).drop("_c")
    return filled.withColumns({
        "change_points": F.coalesce("_last.change_points", F.array().cast("array<int>")),
        "recent_change": F.coalesce("_last.recent_change", F.lit(False)),
    }).drop("_last")
