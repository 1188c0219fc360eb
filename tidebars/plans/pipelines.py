"""The three batch jobs: bars and features from raw files, training, backtest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators import performance as pf
from tidebars.operators.crossasset import cross_asset
from tidebars.operators.features import compute_features
from tidebars.operators.gated import VOTES, replay_while_flat
from tidebars.operators.labels import attach_returns, flat_dataset, require_bars
from tidebars.operators.models import Ensemble, EnsembleConfig, save_run, train_run
from tidebars.operators.regime import classify
from tidebars.operators.regime import votes as votes_of
from tidebars.operators.resample import resample_many
from tidebars.operators.splits import periods_overlap
from tidebars.operators.trades import default_horizon, replay
from tidebars.operators.validate import (
    HISTORICAL_RULES, accepted, check_bars, load_summary, null_profile, rejected, require_no_empty,
)
from tidebars.schema import BARS, FEATURE_COLUMNS, FEATURES, SERIES, timeframe_minutes
from tidebars.session import materialize
from tidebars.sources.tables import read_table, write_table


def ingest(raw: DataFrame, bars_path: str, rejects_path: str | None = None, targets: Sequence[str] = ("15m", "1h", "4h"),
           **options) -> DataFrame:
    """Validate raw 5-minute bars, add the coarser timeframes and upsert all of them; the stored table."""
    checked = check_bars(raw, rules=options.pop("rules", HISTORICAL_RULES), default_timeframe="5m", **options)
    if rejects_path:
        rejected(checked).write.mode("append").parquet(rejects_path)
    write_table(resample_many(accepted(checked), "5m", targets, keep_source=True), bars_path, BARS)
    return read_table(raw.sparkSession, bars_path, BARS)


def build_features(spark: SparkSession, bars_path: str, features_path: str, base: str | None = None,
                   index: str | None = None, gauge: str | None = None, positive_prices: bool | None = None) -> DataFrame:
    """Features of every stored series, with cross-asset columns for ``base``; the stored table.

    Bars whose rules included price bounds have ``positive_prices``; by default the closes are checked.
    """
    bars = read_table(spark, bars_path, BARS).drop("month")
    cross = cross_asset(bars, base, index, gauge) if base and index and gauge else None
    write_table(compute_features(bars, cross, positive_prices), features_path, FEATURES)
    return read_table(spark, features_path, FEATURES)


def summary(spark: SparkSession, bars_path: str, features_path: str) -> DataFrame:
    return load_summary(read_table(spark, bars_path, BARS), read_table(spark, features_path, FEATURES))


def train(features: DataFrame, bars: DataFrame, path: str | None = None, config: EnsembleConfig = EnsembleConfig(),
          folds: int = 5, columns: Sequence[str] = FEATURE_COLUMNS, multiple: float = 0.0) -> tuple[Ensemble, DataFrame]:
    """Labelled dataset, walk-forward folds, final fit. Fails when a feature has no value at all."""
    require_bars(bars)
    require_no_empty(null_profile(features, columns))
    data = flat_dataset(features, bars, config.horizon, multiple)
    data = materialize(attach_returns(data.drop("close", "high", "low"), bars, config.horizon))
    model, results = train_run(data, config, folds)
    if path:
        first, last = data.agg(F.min("ts"), F.max("ts")).first()
        save_run(model, results, path, start=str(first), end=str(last))
    return model, results


def backtest(
    bars: DataFrame,
    signal: DataFrame,
    timeframe: str = "5m",
    spread: float = 0.0,
    regimes: DataFrame | None = None,
    horizon: int | None = None,
    votes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trades, one report row per series) of bars with a ``direction`` per (series, ts) in ``signal``.

    Only warm bars may signal, and with ``regimes`` (decisions of ``regime_table``) only bars whose decision allows
    it; these are worked out on all bars. With ``votes`` (of ``regime_votes``) in their place, dead zone and
    persistence of the regime move on only at warm bars at which no position is open.
    """
    if regimes is not None and votes is not None:
        raise ValueError("give decisions of all bars or votes, not both")
    horizon = horizon or default_horizon(timeframe)
    rows = bars.filter(F.col("timeframe") == timeframe).join(
        signal.select(*SERIES, "ts", "direction", "warmup_complete"), [*SERIES, "ts"], "left")
    allowed: Column = F.col("warmup_complete")
    regime = None
    if regimes is not None:
        rows = rows.join(regimes.select(*SERIES, "ts", F.col("state").alias("regime_state"), "should_trade"),
                         [*SERIES, "ts"], "left")
        allowed, regime = allowed & F.col("should_trade"), "regime_state"
    if votes is not None:
        rows = rows.join(votes.select(*SERIES, "ts", *VOTES), [*SERIES, "ts"], "left")
    rows = materialize(rows)
    if votes is not None:
        found, checked = replay_while_flat(rows, horizon, spread, eligible=allowed)
    else:
        found, checked = replay(rows, horizon, spread, eligible=allowed, regime=regime)
    trades = materialize(found)
    span = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars_processed"), F.min("ts").alias("start_date"),
                                     F.max("ts").alias("end_date"))
    seen = checked.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("signals_generated"))
    numbers = pf.rounded_metrics(pf.trade_metrics(trades, step=timeframe_minutes(timeframe) * 60))
    report = span.join(seen, list(SERIES), "left").join(numbers, list(SERIES), "left").na.fill(0).withColumn(
        "meets_minimum", pf.backtest_accepted())
    return trades, report


def regime_votes(bars: DataFrame, features: DataFrame, daily_states: DataFrame | None = None) -> DataFrame:
    """Votes on the regime at all bars that have features."""
    return votes_of(_bars_with_atr(bars, features), daily_states)


def _bars_with_atr(bars: DataFrame, features: DataFrame) -> DataFrame:
    return bars.select(*SERIES, "ts", "high", "low", "close").join(features.select(*SERIES, "ts", "atr_14"), [*SERIES, "ts"])


def regime_table(bars: DataFrame, features: DataFrame, daily_states: DataFrame | None = None) -> DataFrame:
    """Decisions for all bars that have features."""
    return classify(_bars_with_atr(bars, features), daily_states)


def training_overlaps(runs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Stored runs whose training period overlaps a test period."""
    return runs.filter(periods_overlap(start, end, F.col("start").cast("timestamp"), F.col("end").cast("timestamp")))
