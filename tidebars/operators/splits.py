"""Leak-free train and test folds. Roles follow from a row's position alone, so no join is needed."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.labels import chronological_position
from tidebars.schema import SERIES


def _check(rows: DataFrame, enough: Column, message: str) -> DataFrame:
    """Fail the job when a series is too short, instead of leaving it out unnoticed."""
    text = F.concat(F.lit(message), F.lit(" (rows: "), F.col("series_rows").cast("string"), F.lit(")"))
    return rows.withColumn("series_rows", F.when(enough, F.col("series_rows")).otherwise(
        F.raise_error(text).cast("long")))


def walk_forward(rows: DataFrame, splits: int = 5, train_ratio: float = 0.70, purge: int = 1) -> DataFrame:
    """One row per fold a row takes part in: columns fold (from 0) and role (train or test).

    Fold i trains on the first i+1 of splits+1 segments and tests on the segment after a gap of
    ``purge`` rows. ``train_ratio`` is checked and has no other effect.
    """
    if splits < 2:
        raise ValueError("splits must be at least 2")
    if not 0.5 <= train_ratio < 1.0:
        raise ValueError("train_ratio must be in [0.5, 1)")
    n, at = F.col("series_rows"), F.col("position")
    placed = chronological_position(rows)
    smallest_test = F.greatest(F.lit(10), F.floor(n / (splits * 3)))
    least = smallest_test * splits + purge * splits + 50
    placed = _check(placed, n >= least, f"too few samples for {splits} folds")
    size = F.floor(n / (splits + 1))
    roles = []
    for i in range(splits):
        end = size * (i + 1)
        # a fold without a test row does not exist, and neither do the ones after it
        exists = end + purge < n
        test = (at >= end + purge) & (at < end + purge + size)
        role = F.when(at < end, "train").when(test, "test")
        roles.append(F.when(exists & role.isNotNull(), F.struct(F.lit(i).alias("fold"), role.alias("role"))))
    return placed.withColumn("_r", F.explode(F.array_compact(F.array(*roles)))).select(
        *[c for c in placed.columns if c != "series_rows"], "_r.fold", "_r.role")


def purged_combinations(rows: DataFrame, groups: int = 5, test_groups: int = 2, purge: int = 1,
                        embargo: float = 0.01) -> DataFrame:
    """All choices of ``test_groups`` among ``groups`` time groups: columns fold and role.

    Rows next to a test group are left out: ``purge`` before it, ``embargo`` of all rows after it.
    """
    if test_groups >= groups:
        raise ValueError("test_groups must be below groups")
    n, at = F.col("series_rows"), F.col("position")
    size = F.floor(n / groups)
    placed = _check(chronological_position(rows), size >= 10, f"too few samples for {groups} groups")
    gap = F.greatest(F.lit(1), F.floor(n * embargo))

    def bounds(g: int) -> tuple[Column, Column]:
        return size * g, (n if g == groups - 1 else size * (g + 1))

    roles = []
    for fold, chosen in enumerate(combinations(range(groups), test_groups)):
        tested, dropped = F.lit(False), F.lit(False)
        for g in chosen:
            first, end = bounds(g)
            tested = tested | ((at >= first) & (at < end))
            dropped = dropped | ((at >= first - purge) & (at < first)) | ((at >= end) & (at < end + gap))
        role = F.when(tested, "test").when(~dropped, "train")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(fold).alias("fold"), role.alias("role"))))
    return placed.withColumn("_r", F.explode(F.array_compact(F.array(*roles)))).select(
        *[c for c in placed.columns if c != "series_rows"], "_r.fold", "_r.role")


def fold_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy(*SERIES, "fold").agg(
        F.count_if(F.col("role") == "train").alias("train_size"), F.count_if(F.col("role") == "test").alias("test_size"),
        F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("train_end"),
        F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("test_start"))


def periods_overlap(start: Column, end: Column, train_start: Column, train_end: Column) -> Column:
    """A test period that shares time with a training period."""
    return (start <= train_end) & (end >= train_start)
