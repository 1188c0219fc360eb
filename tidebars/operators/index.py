"""Synthetic indices from several instruments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.schema import BARS, DOLLAR_INDEX_CONSTANT, DOLLAR_INDEX_WEIGHTS

PRICES = ("open", "high", "low", "close")


def align_by_time(bars: DataFrame, symbols: Sequence[str], columns: Sequence[str] = PRICES) -> DataFrame:
    """One row per (timeframe, ts) at which every symbol has a bar: columns ``<column>_<i>`` by symbol position.

    A conditional aggregate instead of a chain of joins: one shuffle, combined on the map side.
    """
    wide = bars.filter(F.col("symbol").isin(*symbols)).groupBy("timeframe", "ts").agg(
        *[F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{c}_{i}")
          for i, s in enumerate(symbols) for c in columns],
        *[F.count_if(F.col("symbol") == s).alias(f"_has_{i}") for i, s in enumerate(symbols)])
    for i in range(len(symbols)):
        wide = wide.filter(F.col(f"_has_{i}") > 0)
    return wide.drop(*[f"_has_{i}" for i in range(len(symbols))])


def require_components(bars: DataFrame, symbols: Sequence[str]) -> None:
    """Error naming the components without a single bar (at most one row per component is read)."""
    present = {r["symbol"] for r in bars.filter(F.col("symbol").isin(*symbols)).select("symbol").distinct().collect()}
    missing = [s for s in symbols if s not in present]
    if missing:
        raise ValueError(f"no bars for index components: {', '.join(missing)}")


def missing_components(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Times at which some components have no bar, with the missing ones."""
    listed = F.array(*[F.lit(s) for s in symbols])
    return bars.filter(F.col("symbol").isin(*symbols)).groupBy("timeframe", "ts").agg(
        F.array_sort(F.array_except(listed, F.collect_set("symbol"))).alias("missing")
    ).filter(F.size("missing") > 0)


def _value(prices: list[Column], weights: list[float], constant: float) -> Column:
    """constant * prod(price^weight); null where a price has no such power."""
    out = F.lit(constant)
    valid = F.lit(True)
    for price, weight in zip(prices, weights):
        out = out * F.pow(price, F.lit(weight))
        valid = valid & (price > 0 if weight < 0 else price >= 0)
    return F.when(valid, out)


def geometric_index(
    bars: DataFrame,
    weights: Mapping[str, float] = DOLLAR_INDEX_WEIGHTS,
    constant: float = DOLLAR_INDEX_CONSTANT,
    name: str = "DXY_SYNTH",
    close_only: bool = False,
) -> DataFrame:
    """Index bars where every component has a bar; rows whose value does not exist are left out.

    The high takes highs of components with a positive exponent and lows of the others, the low the
    reverse; both are widened to cover open and close.
    """
    symbols, powers = list(weights), list(weights.values())
    columns = ("close",) if close_only else PRICES
    wide = align_by_time(bars, symbols, columns)

    def value(pick) -> Column:
        return _value([F.col(f"{pick(w)}_{i}") for i, w in enumerate(powers)], powers, constant)

    close = value(lambda w: "close")
    if close_only:
        out = wide.select("timeframe", "ts", *[close.alias(p) for p in PRICES])
    else:
        four = wide.select(
            "timeframe", "ts", value(lambda w: "open").alias("open"), close.alias("close"),
            value(lambda w: "high" if w > 0 else "low").alias("_up"),
            value(lambda w: "low" if w > 0 else "high").alias("_down"),
        ).na.drop()
        every = [F.col(c) for c in ("open", "close", "_up", "_down")]
        out = four.withColumns({"high": F.greatest(*every), "low": F.least(*every)})
    return out.na.drop(subset=list(PRICES)).select(
        F.lit(name).alias("symbol"), "timeframe", "ts", *PRICES,
        F.lit(0.0).alias("volume"), F.lit(True).alias("is_complete")).select(*BARS.fieldNames())


def coverage(bars: DataFrame, index: DataFrame, symbols: Sequence[str], low: float = 50.0, high: float = 150.0
             ) -> DataFrame:
    """How much of the component bars the index uses, and whether its closes stay in the expected range."""
    used = bars.filter(F.col("symbol").isin(*symbols)).select(F.lit(1).alias("part"), F.lit(None).cast("double").alias("c"))
    both = used.unionByName(index.select(F.lit(0).alias("part"), F.col("close").alias("c")))
    return both.agg(
        F.count_if(F.col("part") == 1).alias("total_bars"), F.count_if(F.col("part") == 0).alias("index_bars"),
        F.min("c").alias("min_close"), F.max("c").alias("max_close"), F.avg("c").alias("avg_close"),
    ).withColumns({
        "coverage": F.try_divide(F.col("index_bars") * len(symbols), F.col("total_bars")),
        "out_of_range": (F.col("min_close") < low) | (F.col("max_close") > high),
    })
