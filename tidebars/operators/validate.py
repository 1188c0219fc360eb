"""Bar validation and normalization. A bad row never fails a job: it carries the first failed rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.bars import parse_timeframe
from tidebars.schema import BARS, SYMBOL_SPECS, SYMBOLS

PRICES = ("open", "high", "low", "close")
EXACT = T.DecimalType(38, 12)
_NUMBERS = [f"_{c}" for c in (*PRICES, "volume")]
REJECT_TYPE = "struct<field:string,rule:string,value:string>"


def _fail(condition: Column, field: str, rule: str, value: Column) -> Column:
    return F.when(condition, F.struct(
        F.lit(field).alias("field"), F.lit(rule).alias("rule"), value.cast("string").alias("value")))


def _first(failures: Sequence[Column]) -> Column:
    return F.coalesce(*failures, F.lit(None).cast(REJECT_TYPE))


def number(field: str) -> Column:
    """The number in a raw text field, read once per row by ``check_bars``; null when there is none."""
    return F.col(f"_{field}")


def _readable(field: str) -> list[Column]:
    raw = F.col(field)
    return [
        _fail(raw.isNull(), field, "not_none", raw),
        _fail(raw.isNotNull() & number(field).isNull(), field, "decimal_conversion", raw),
    ]


@dataclass(frozen=True)
class Rule:
    """A named check: ``check(now)`` gives the failure (field, rule, value) of a row, or null."""

    name: str
    check: Callable[[Column], Column]


def predicate_rule(name: str, field: str, passes: Column) -> Rule:
    """A user rule from a boolean column over the raw columns; null counts as passed."""
    return Rule(name, lambda now: _fail(~F.coalesce(passes, F.lit(True)), field, name, F.col(field)))


def _age(now: Column) -> Column:
    return F.unix_micros(now) / 1e6 - F.unix_micros("ts") / 1e6


def timestamp_not_future(tolerance: float = 5.0) -> Rule:
    return Rule("timestamp_not_future", lambda now: _fail(
        _age(now) < -tolerance, "timestamp", "timestamp_not_future", F.col("ts")))


def timestamp_not_stale(limit: float = 120.0) -> Rule:
    return Rule("timestamp_not_stale", lambda now: _fail(
        _age(now) > limit, "timestamp", "timestamp_not_stale", F.col("ts")))


def price_bounds(specs: dict[str, tuple[str, float, float]] = SYMBOL_SPECS) -> Rule:
    """Every price within the bounds of its symbol; symbols without bounds pass."""
    table = [(s, lo, hi) for s, (_, lo, hi) in specs.items()]

    def bound(i: int) -> Column:
        out = F.lit(None).cast("double")
        for row in table:
            out = F.when(F.col("symbol") == row[0], F.lit(float(row[i]))).otherwise(out)
        return out

    def check(now: Column) -> Column:
        listed = F.col("symbol").isin(*specs)
        failures = []
        for p in PRICES:
            outside = (number(p) < bound(1)) | (number(p) > bound(2))
            failures += [F.when(listed, f) for f in _readable(p)]
            failures.append(_fail(listed & outside, p, "price_bounds", F.col(p)))
        return _first(failures)

    return Rule("price_bounds", check)


def ohlc_consistency() -> Rule:
    def check(now: Column) -> Column:
        o, h, l, c = (number(p) for p in PRICES)
        name = "ohlc_consistency"
        return _first([
            *[f for p in ("open", "high", "low", "close") for f in _readable(p)],
            _fail(l > h, "low", name, F.col("low")),
            _fail((o < l) | (o > h), "open", name, F.col("open")),
            _fail((c < l) | (c > h), "close", name, F.col("close")),
        ])

    return Rule("ohlc_consistency", check)


def volume_non_negative() -> Rule:
    def check(now: Column) -> Column:
        v = F.col("volume")
        return _first([
            _fail(v.isNotNull() & number("volume").isNull(), "volume", "decimal_conversion", v),
            _fail(number("volume") < 0, "volume", "volume_non_negative", v),
        ])

    return Rule("volume_non_negative", check)


DEFAULT_RULES = [timestamp_not_future(), price_bounds(), ohlc_consistency(), volume_non_negative()]
LIVE_RULES = [DEFAULT_RULES[0], timestamp_not_stale(), *DEFAULT_RULES[1:]]
HISTORICAL_RULES = DEFAULT_RULES[1:]


def check_bars(
    raw: DataFrame,
    default_symbol: str = "XAUUSD",
    default_timeframe: str = "1m",
    rules: Sequence[Rule] = tuple(DEFAULT_RULES),
    now: Column | None = None,
) -> DataFrame:
    """Raw bars with symbol and timeframe filled in and ``reject``: the first failed rule, or null."""
    now = F.current_timestamp() if now is None else now

    def given(column: str, default: str) -> Column:
        text = F.col(column)
        return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)

    filled = raw.withColumns({
        "symbol": F.upper(given("symbol", default_symbol)),
        "timeframe": given("timeframe", default_timeframe),
    })
    # A decimal decides what counts as a number; comparing is left to doubles. The explode of one struct
    # keeps the optimizer from copying the casts into each of the many places that refer to them.
    numbers = F.struct(*[F.col(c).try_cast(EXACT).cast("double").alias(f"_{c}") for c in (*PRICES, "volume")])
    filled = filled.select("*", F.explode(F.array(numbers)).alias("_n")).select(*filled.columns, "_n.*")
    # what the bar itself insists on, whichever rules are chosen
    built_in = [
        *[_fail(number(p).isNull(), p, "decimal_conversion", F.col(p)) for p in PRICES],
        _fail(F.col("volume").isNotNull() & number("volume").isNull(), "volume", "decimal_conversion", F.col("volume")),
        _fail(F.col("ts").isNull(), "timestamp", "not_none", F.col("ts")),
        _fail(parse_timeframe(F.col("timeframe")).isNull(), "timeframe", "timeframe", F.col("timeframe")),
        ohlc_consistency().check(now),
    ]
    return filled.withColumn("reject", _first([rule.check(now) for rule in rules] + built_in))


def accepted(checked: DataFrame) -> DataFrame:
    """The normalized bars among checked ones: UTC times, double prices, missing volume as zero."""
    return checked.filter(F.col("reject").isNull()).select(
        "symbol",
        parse_timeframe(F.col("timeframe")).alias("timeframe"),
        "ts",
        *[number(p).alias(p) for p in PRICES],
        F.coalesce(number("volume"), F.lit(0.0)).alias("volume"),
        F.lit(True).alias("is_complete"),
    ).select(*BARS.fieldNames())


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject").isNotNull()).select(
        *[c for c in checked.columns if c != "reject" and c not in _NUMBERS], "reject.field", "reject.rule", "reject.value")


def normalize_bars(raw: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(normalized bars, rejected rows with field, rule and value)."""
    checked = check_bars(raw, **options)
    return accepted(checked), rejected(checked)


def symbol_table(spark: SparkSession) -> DataFrame:
    """The symbol dimension: a fixed table of a dozen rows."""
    rows = []
    for s, (exchange, kind, currency, timeframes, tradeable) in SYMBOLS.items():
        pip, lo, hi = SYMBOL_SPECS.get(s, (None, None, None))
        rows.append((s, exchange, kind, currency, list(timeframes), tradeable,
                     float(pip) if pip else None, lo, hi))
    return spark.createDataFrame(rows, (
        "symbol string, exchange string, security_type string, currency string, timeframes array<string>, "
        "is_tradeable boolean, pip_size double, min_price double, max_price double"))


def list_symbols() -> list[str]:
    return list(SYMBOLS)


def symbol_config(name: str) -> dict:
    key = name.upper()
    if key not in SYMBOLS:
        raise ValueError(f"no symbol {name}; there are: {', '.join(sorted(SYMBOLS))}")
    return dict(zip(("exchange", "security_type", "currency", "timeframes", "is_tradeable"), SYMBOLS[key]))


def unknown_symbols(bars: DataFrame) -> DataFrame:
    """Symbols of the data that the dimension does not list, with their row counts."""
    return bars.groupBy(F.upper("symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("rows")).join(
        symbol_table(bars.sparkSession).select("symbol"), "symbol", "left_anti")


def null_profile(df: DataFrame, columns: Sequence[str], sparse: float = 0.5) -> DataFrame:
    """Share of nulls per column in one pass, with status ok, sparse (> ``sparse``) or empty."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = shares.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_share")) for c in columns])).alias("x"))
    return long.select("x.feature", "x.null_share").withColumn("status", F.when(F.col("null_share") == 1.0, "empty")
                                                   .when(F.col("null_share") > sparse, "sparse").otherwise("ok"))


def require_no_empty(profile: DataFrame) -> None:
    """Error naming the columns without a single value (the profile has one row per column)."""
    empty = [r["feature"] for r in profile.filter("status = 'empty'").collect()]
    if empty:
        raise ValueError(f"feature columns without any value: {sorted(empty)}")


def load_summary(bars: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Rows per symbol and timeframe, with feature and warm-up counts when features are given."""
    counts = bars.groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    if features is None:
        return counts
    warm = features.groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("features"), F.count_if("warmup_complete").alias("warm"))
    return counts.join(warm, ["symbol", "timeframe"], "left").na.fill(0, ["features", "warm"])
