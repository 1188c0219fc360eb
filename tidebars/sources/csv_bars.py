"""CSV bar files: column mapping, many date formats, quarantine of malformed rows, load stats."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: accepted formats, the first that matches wins
DATETIME_FORMATS = (
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d'T'H:m:sXX",
    "yyyy/M/d H:m:s",
    "yyyy/M/d H:m",
    "M/d/yyyy H:m:s",
    "M/d/yyyy H:m",
    "d.M.yyyy H:m:s",
    "d.M.yyyy H:m",
)


class ColumnMapping(NamedTuple):
    """Header names of a file; the volume column may be absent."""

    datetime: str = "datetime"
    open: str = "open"
    high: str = "high"
    low: str = "low"
    close: str = "close"
    volume: str = "volume"


class Loaded(NamedTuple):
    bars: DataFrame      # RAW_BARS
    rejects: DataFrame   # the same text columns plus error
    stats: DataFrame     # one row


def _shape(pattern: str) -> str:
    """Regular expression of the texts a pattern can match: trying a pattern in vain is the dear part."""
    out = ["^"]
    for literal, letters, _, other in re.findall(r"'([^']*)'|(([A-Za-z])\3*)|(.)", pattern):
        if letters.startswith("X"):
            out.append(r"(Z|[+-]\d{2}:\d{2})" if len(letters) == 3 else r"(Z|[+-]\d{4})")
        elif letters:
            out.append(r"\d{4}" if len(letters) == 4 else r"\d{1,2}")
        else:
            out.append(re.escape(literal or other))
    return "".join(out) + "$"


def parse_datetime(text: Column, formats: Sequence[str] = DATETIME_FORMATS) -> Column:
    return F.coalesce(*[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats])


def load_csv(
    spark: SparkSession,
    path: str,
    symbol: str,
    timeframe: str | None = None,
    mapping: ColumnMapping = ColumnMapping(),
    formats: Sequence[str] = DATETIME_FORMATS,
) -> Loaded:
    header = spark.read.option("header", True).csv(path).columns
    if not header:
        raise ValueError(f"{path} is empty")
    by_name = {name.strip(): name for name in header}
    required = {mapping.datetime, mapping.open, mapping.high, mapping.low, mapping.close}
    missing = required - set(by_name)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are not in the header of {path}; it has {sorted(by_name)}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    text = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)

    def field(name: str) -> Column:
        return F.trim(F.col(f"`{by_name[name]}`")) if name in by_name else F.lit(None).cast("string")

    volume = field(mapping.volume)
    rows = text.select(
        field(mapping.datetime).alias("datetime"),
        *[field(getattr(mapping, p)).alias(p) for p in ("open", "high", "low", "close")],
        F.when(volume != "", volume).alias("volume"),
    ).withColumn("ts", parse_datetime(F.col("datetime"), formats))
    # short lines leave trailing fields null
    absent = [F.when(F.col(p).isNull(), F.lit(f"missing field '{p}'")) for p in ("open", "high", "low", "close")]
    rows = rows.withColumn("error", F.coalesce(
        F.when(F.col("ts").isNull(),
               F.concat(F.lit("no known date format: "), F.coalesce("datetime", F.lit("")))),
        *absent))
    good = rows.filter(F.col("error").isNull()).select(
        "ts", "open", "high", "low", "close", "volume",
        F.lit(symbol).alias("symbol"), F.lit(timeframe).cast("string").alias("timeframe"))
    bad = rows.filter(F.col("error").isNotNull()).drop("ts")
    return Loaded(good, bad, load_stats(rows))


def load_stats(rows: DataFrame) -> DataFrame:
    """rows_loaded, rows_skipped, start and end of rows with ``ts`` and ``error`` columns."""
    ok = F.col("error").isNull()
    return rows.agg(
        F.count_if(ok).alias("rows_loaded"), F.count_if(~ok).alias("rows_skipped"),
        F.min(F.when(ok, F.col("ts"))).alias("start_date"), F.max(F.when(ok, F.col("ts"))).alias("end_date"))


def date_range(bars: DataFrame) -> DataFrame:
    return bars.agg(F.min("ts").alias("start_date"), F.max("ts").alias("end_date"))
