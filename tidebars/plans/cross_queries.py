"""Registered queries: indices, cross-asset features, as-of joins and observation vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators.asof import asof_join
from tidebars.operators.crossasset import cross_asset
from tidebars.operators.features import compute_features
from tidebars.operators.index import align_by_time, coverage, geometric_index, missing_components
from tidebars.operators.observe import ObservationSpec, WindowSpec, observations
from tidebars.operators.resample import resample_many
from tidebars.plans.common import rounded
from tidebars.session import materialize
from tidebars.sources.driver_tables import event_bars

INDEX_CONSTANT = 50.14348112
INDEX_WEIGHTS = {"click": -0.576, "error": 0.136, "purchase": -0.119, "signup": 0.091, "view": 0.042}
BASE, INDEX, GAUGE = "purchase", "click", "view"


def _lifted(bars: DataFrame) -> DataFrame:
    """The events' values as prices above zero."""
    return bars.withColumns({p: F.col(p) + 1 for p in ("open", "high", "low", "close")})


def _index(spark: SparkSession, folder: str, **options) -> DataFrame:
    return geometric_index(_lifted(event_bars(spark, folder, "1h")), INDEX_WEIGHTS, INDEX_CONSTANT, "INDEX", **options)


def aligned_pivot(spark: SparkSession, folder: str) -> DataFrame:
    wide = align_by_time(event_bars(spark, folder, "1h"), list(INDEX_WEIGHTS), ["close"])
    return wide.select("ts", *[F.col(f"close_{i}").alias(s) for i, s in enumerate(INDEX_WEIGHTS)])


def index_bars(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_index(spark, folder).select("symbol", "ts", "open", "high", "low", "close"))


def index_close_only(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_index(spark, folder, close_only=True).select("symbol", "ts", "open", "high", "low", "close"))


def index_missing(spark: SparkSession, folder: str) -> DataFrame:
    out = missing_components(event_bars(spark, folder, "1h"), list(INDEX_WEIGHTS))
    return out.select("ts", F.concat_ws(",", "missing").alias("missing"))


def index_coverage(spark: SparkSession, folder: str) -> DataFrame:
    bars = _lifted(event_bars(spark, folder, "1h"))
    return rounded(coverage(bars, _index(spark, folder), list(INDEX_WEIGHTS)))


def cross_asset_features(spark: SparkSession, folder: str) -> DataFrame:
    out = cross_asset(event_bars(spark, folder, "1h"), BASE, INDEX, GAUGE)
    return rounded(out.select("symbol", "ts", "dxy_return_1h", "dxy_rsi_14", "vix_level", "vix_change"))


def asof_multi_tf(spark: SparkSession, folder: str) -> DataFrame:
    """Every 5-minute bar with the newest complete 1-hour bar."""
    bars = event_bars(spark, folder, "5m")
    hours = resample_many(bars, "5m", ["1h"]).select("symbol", "ts", F.col("close").alias("hour_close"),
                                                     F.col("volume").alias("hour_volume"))
    ready = F.col("ts") + F.expr("INTERVAL 1 HOUR")
    return asof_join(bars.select("symbol", "ts", "close"), hours, ["symbol"], 300, available=ready)


def observation_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Observation vectors of 1h bars with 4h context (the grid the events fill at every scale factor)."""
    hours = event_bars(spark, folder, "1h")
    bars = hours.unionByName(resample_many(hours, "1h", ["4h"]))
    # read once per window, so it is written once
    features = materialize(rounded(compute_features(bars)).join(
        bars.select("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"), ["symbol", "timeframe", "ts"]))
    spec = ObservationSpec("1h", (WindowSpec("1h", 6, ohlcv=True), WindowSpec("4h", 3)), regime=True)
    return observations(features, spec)


QUERIES = {
    f.__name__: f for f in (
        aligned_pivot, index_bars, index_close_only, index_missing, index_coverage, cross_asset_features,
        asof_multi_tf, observation_vectors,
    )
}
