"""Bars from ticks and coarser bars from finer ones: one hash aggregate, partial on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.bars import align
from tidebars.operators.blocks import blocked, block_window, own_rows
from tidebars.schema import BARS, RESAMPLE_RATIOS, timeframe_minutes


def _ohlc(order: Column | str = "ts") -> list[Column]:
    return [
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def bars_from_ticks(ticks: DataFrame, timeframe: str, symbol: str = "symbol", ts: str = "ts",
                    price: str = "price", order: str | None = None) -> DataFrame:
    """One bar per symbol and period with at least one tick; volume counts the ticks."""
    seconds = timeframe_minutes(timeframe) * 60
    p, rank = F.col(price).cast("double"), F.col(order or ts)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), align(F.col(ts).cast("timestamp"), seconds).alias("_start"))
        .agg(
            F.min_by(p, rank).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"),
            F.max_by(p, rank).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_start").alias("ts"),
                "open", "high", "low", "close", "volume", F.lit(True).alias("is_complete"))
    )


def check_pair(source: str, target: str) -> int:
    """Source bars per complete target bar; an error for pairs that cannot be resampled."""
    if (source, target) not in RESAMPLE_RATIOS:
        known = ", ".join(f"{s}->{t}" for s, t in RESAMPLE_RATIOS)
        raise ValueError(f"cannot resample {source} to {target}; supported: {known}")
    return RESAMPLE_RATIOS[(source, target)]


def require_homogeneous(bars: DataFrame) -> None:
    """Error unless the bars are of exactly one symbol and one timeframe (one small aggregate)."""
    row = bars.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{n}_{c}") for c in ("symbol", "timeframe") for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    if row["n"] == 0:
        raise ValueError("no bars to aggregate")
    for c in ("symbol", "timeframe"):
        if row[f"lo_{c}"] != row[f"hi_{c}"]:
            raise ValueError(f"bars of more than one {c}: {row[f'lo_{c}']}, {row[f'hi_{c}']}, ...")


def resample(bars: DataFrame, source: str, target: str) -> DataFrame:
    """Coarser bars of every symbol; ``is_complete`` when every source bar of the period was there."""
    return resample_many(bars, source, [target])


def resample_many(bars: DataFrame, source: str, targets: Sequence[str], keep_source: bool = False) -> DataFrame:
    """Several target timeframes in one pass: one expand and one aggregate for all of them."""
    source = source.strip().lower()
    wanted = [t.strip().lower() for t in targets]
    needed = {t: check_pair(source, t) for t in wanted}
    base = bars.filter(F.col("timeframe") == source)
    table = F.array(*[
        F.struct(F.lit(t).alias("tf"), F.lit(timeframe_minutes(t) * 60).alias("sec"), F.lit(n).alias("need"))
        for t, n in needed.items()
    ])
    coarse = (
        base.withColumn("_t", F.explode(table))
        .groupBy("symbol", F.col("_t.tf").alias("timeframe"), align("ts", F.col("_t.sec")).alias("_start"),
                 F.col("_t.need").alias("_need"))
        .agg(*_ohlc(), F.count(F.lit(1)).alias("_n"))
        .select("symbol", "timeframe", F.col("_start").alias("ts"), "open", "high", "low", "close", "volume",
                (F.col("_n") == F.col("_need")).alias("is_complete"))
    )
    if not keep_source:
        return coarse
    return base.select(*BARS.fieldNames()).unionByName(coarse)


def sample_daily(bars: DataFrame, timeframe: str | None = "5m") -> DataFrame:
    """Daily bars of one source timeframe; ``None`` mixes all timeframes, as a plain time bucket would."""
    base = bars if timeframe is None else bars.filter(F.col("timeframe") == timeframe)
    # of bars that open at the same time the coarser one closes last
    order = F.struct("ts", F.length("timeframe"), "timeframe") if timeframe is None else F.col("ts")
    return base.groupBy("symbol", F.date_trunc("DAY", "ts").alias("day")).agg(*_ohlc(order)).select(
        "symbol", F.lit("1d").alias("timeframe"), F.col("day").alias("ts"), "open", "high", "low", "close", "volume"
    )


def weekend_gaps(bars: DataFrame) -> DataFrame:
    """``weekend_gap`` marks a Friday bar whose next bar of the series is on a Monday."""
    w = block_window()
    marked = blocked(bars, fwd=1).withColumn(
        "weekend_gap",
        F.coalesce((F.weekday("ts") == 4) & (F.weekday(F.lead("ts").over(w)) == 0), F.lit(False)),
    )
    return own_rows(marked)
