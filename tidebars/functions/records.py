"""Rows as JSON records and back, and the topics records are published under."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.schema import BARS, FEATURES, REGIME, SIGNALS, TIMEFRAME_MINUTES

# fixed values: what a record means when it leaves a field out
DEFAULTS = {
    "bar": {"is_complete": True},
    "features": {
        **{c: False for c in ("is_london_session", "is_ny_session", "is_overlap_session", "is_asian_session",
                              "is_month_turn", "warmup_complete")},
        "hour_of_day": 0, "day_of_week": 0,
    },
    "regime": {"atr_expanding": False, "session_bias": 1.0},
    "signal": {"warmup_complete": False},
}
REQUIRED = {
    "bar": ["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"],
    "features": ["symbol", "timeframe", "ts"],
    "regime": ["symbol", "ts", "state", "confidence", "position_multiplier", "should_trade", "reason"],
    "signal": ["symbol", "ts", "direction", "confidence", "predicted_horizon"],
}
SCHEMAS = {"bar": BARS, "features": FEATURES, "regime": REGIME, "signal": SIGNALS}
TEXT_NUMBERS = {"bar": {"open", "high", "low", "close", "volume"}}


def iso_time(ts: Column) -> Column:
    """ISO 8601 with offset; a fraction only where there is one."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.date_format(ts, "xxx"))


def exact_text(number: Column) -> Column:
    """All digits of a number, without an exponent where 38 digits hold it."""
    text = number.cast("string")
    plain = F.regexp_replace(number.try_cast(T.DecimalType(38, 18)).cast("string"), r"\.?0+$", "")
    same = plain.try_cast("double") == number.cast("double")
    return F.when(text.contains("E") & same, plain).otherwise(text)


def to_record(kind: str) -> Column:
    """The JSON text of a row of the ``kind`` table: times in ISO form, bar numbers as text, nulls kept."""
    fields = []
    for f in SCHEMAS[kind].fields:
        column = F.col(f.name)
        if f.name == "ts":
            fields.append(iso_time(column).alias("timestamp"))
        elif f.name in TEXT_NUMBERS.get(kind, set()):
            fields.append(exact_text(column).alias(f.name))
        else:
            fields.append(column.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def from_record(kind: str, text: Column | str) -> Column:
    """A struct of the ``kind`` table from JSON text; null when the record lacks a required field."""
    text = F.col(text) if isinstance(text, str) else text
    schema = SCHEMAS[kind]
    as_text = TEXT_NUMBERS.get(kind, set())
    wire = T.StructType([
        T.StructField("timestamp", T.StringType()) if f.name == "ts"
        else T.StructField(f.name, T.StringType() if f.name in as_text else f.dataType)
        for f in schema.fields
    ])
    row = F.from_json(text, wire)
    values: dict[str, Column] = {}
    for f in schema.fields:
        if f.name == "ts":
            value = row["timestamp"].try_cast("timestamp")
        elif f.name in as_text:
            value = row[f.name].try_cast(f.dataType)
        else:
            value = row[f.name]
        if f.name in DEFAULTS[kind]:
            value = F.coalesce(value, F.lit(DEFAULTS[kind][f.name]).cast(f.dataType))
        if f.name == "timeframe" and kind in ("bar", "features"):
            label = F.lower(F.trim(value))
            value = F.when(label.isin(*TIMEFRAME_MINUTES), label)
        if f.name == "top_features":
            value = F.coalesce(value, F.create_map().cast(f.dataType))
        values[f.name] = value
    whole = F.lit(True)
    for name in REQUIRED[kind]:
        whole = whole & values[name].isNotNull()
    return F.when(whole, F.struct(*[v.alias(n) for n, v in values.items()]))


def topic(kind: str) -> Column:
    """bar.<symbol>.<timeframe>, or <kind>.<symbol>; lower case."""
    symbol = F.lower("symbol")
    if kind == "bar":
        return F.concat_ws(".", F.lit("bar"), symbol, F.col("timeframe"))
    return F.concat_ws(".", F.lit(kind), symbol)
