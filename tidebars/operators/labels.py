"""Forward-looking labels and the training tables made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.bars import feature_array
from tidebars.operators.blocks import ROW, block_window, blocked, own_rows, run_stages
from tidebars.operators.indicators import rolling_mean_atr_stages
from tidebars.schema import FEATURE_COLUMNS, SERIES

HORIZON = 24   # fixed value: bars ahead
LOOKBACK = 48  # fixed value: rows of a sequence
MIN_BARS = 100


def forward_return(rows: DataFrame, horizon: int = HORIZON, name: str = "forward_return") -> DataFrame:
    """(close ``horizon`` bars ahead - close) / close; 0 where there is no such bar."""
    later = F.lead("close", horizon).over(block_window())
    change = (later - F.col("close")) / F.nullif(F.col("close"), F.lit(0.0))
    return own_rows(blocked(rows, fwd=horizon).withColumn(name, F.coalesce(change, F.lit(0.0))))


def sign_label(rows: DataFrame, horizon: int = HORIZON, name: str = "label") -> DataFrame:
    """1 if the price is higher ``horizon`` rows ahead, 0 if not, null at the end of the series."""
    change = F.lead("close", horizon).over(block_window()) - F.col("close")
    return own_rows(blocked(rows, fwd=horizon).withColumn(
        name, F.when(change > 0, 1.0).when(change <= 0, 0.0)))


def atr_label(rows: DataFrame, horizon: int = HORIZON, multiple: float = 1.0, name: str = "label") -> DataFrame:
    """1 or 0 for moves beyond ``multiple`` ATR, null in between; plain-mean ATR where no atr_14 is given."""
    change = F.lead("close", horizon).over(block_window()) - F.col("close")
    given = "atr_14" in rows.columns
    stages = [] if given else [rolling_mean_atr_stages(14, "_t_atr")]
    wide = blocked(rows, back=0 if given else 15, fwd=horizon)
    limit = F.col("atr_14" if given else "_t_atr") * multiple
    last: list[dict[str, Column]] = [{}, {}, {name: F.when(change > limit, 1.0).when(change < -limit, 0.0)}]
    return own_rows(run_stages(wide, *stages, last))


def labeled(rows: DataFrame, horizon: int = HORIZON, multiple: float = 0.0) -> DataFrame:
    return sign_label(rows, horizon) if multiple == 0 else atr_label(rows, horizon, multiple)


def flat_dataset(features: DataFrame, bars: DataFrame, horizon: int = HORIZON, multiple: float = 0.0) -> DataFrame:
    """Feature rows with a label: joined to their bars, labelled, then rows without label or with a null dropped."""
    prices = bars.select(*SERIES, "ts", "close", "high", "low")
    joined = features.join(prices, [*SERIES, "ts"])
    return labeled(joined, horizon, multiple).filter(F.col("label").isNotNull()).na.drop(subset=list(FEATURE_COLUMNS))


def require_bars(bars: DataFrame, least: int = MIN_BARS) -> None:
    """Error when a series is shorter than ``least`` (one row per short series is read)."""
    short = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least).limit(1).collect()
    if short:
        raise ValueError(f"need at least {least} bars, {short[0]['symbol']} {short[0]['timeframe']} has {short[0]['n']}")


def attach_returns(dataset: DataFrame, bars: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Forward returns computed on all bars, joined to the dataset's rows; 0 where missing."""
    returns = forward_return(bars.select(*SERIES, "ts", "close"), horizon).select(*SERIES, "ts", "forward_return")
    return dataset.join(returns, [*SERIES, "ts"], "left").na.fill(0.0, ["forward_return"])


def sequences(dataset: DataFrame, lookback: int = LOOKBACK, columns: Sequence[str] | None = None,
              vector: str | None = None, name: str = "sequence") -> DataFrame:
    """The last ``lookback`` rows as one array of arrays; rows with fewer before them are dropped."""
    value = F.col(vector) if vector else feature_array(list(columns) if columns else None)
    frame = block_window().rowsBetween(-(lookback - 1), 0)
    out = blocked(dataset.withColumn("_v", value), back=lookback).withColumn(
        name, F.when(F.col(ROW) >= lookback, F.collect_list("_v").over(frame)))
    return own_rows(out).drop("_v").filter(F.col(name).isNotNull())


def fit_scaler(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(feature, mean, scale) per group: population deviation, 1 where a column does not vary."""
    stats = rows.groupBy(*keys).agg(*[
        F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias("sd")).alias(f"_{i}") for i, c in enumerate(columns)])
    long = stats.select(*keys, F.explode(F.array(*[F.col(f"_{i}") for i in range(len(columns))])).alias("x"))
    return long.select(*keys, "x.feature", "x.mean",
                       F.when(F.col("x.sd") == 0, 1.0).otherwise(F.col("x.sd")).alias("scale"))


def apply_scaler(rows: DataFrame, scaler: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Standardize ``columns``; the scaler has one row per column and group.

    Without groups these few rows become literals; with groups they are joined.
    """
    if not keys:
        stats = {r["feature"]: r for r in scaler.filter(F.col("feature").isin(*columns)).collect()}
        return rows.withColumns({
            c: (F.col(c).cast("double") - F.lit(stats[c]["mean"])) / F.lit(stats[c]["scale"]) for c in columns})
    wide = scaler.groupBy(*keys).agg(F.map_from_entries(
        F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("_scaler"))
    joined = rows.join(wide, list(keys))
    return joined.withColumns({
        c: (F.col(c).cast("double") - F.col("_scaler")[c]["mean"]) / F.col("_scaler")[c]["scale"] for c in columns
    }).drop("_scaler")


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> DataFrame:
    return spark.read.schema("feature string, mean double, scale double").parquet(path)


def chronological_position(rows: DataFrame, name: str = "position") -> DataFrame:
    """0-based position in the series and ``series_rows``, the length of it."""
    numbered = own_rows(blocked(rows, total="series_rows"), keep_row=True)
    return numbered.withColumn(name, F.col(ROW) - 1).drop(ROW)
