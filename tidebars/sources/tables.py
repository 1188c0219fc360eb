"""Bars and features at rest: Parquet partitioned by symbol, timeframe and month, with upserts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ("symbol", "timeframe", "month")
KEYS = ("symbol", "timeframe", "ts")

# fixed values: columns of the feature export, in file order
EXPORT_COLUMNS = [
    "symbol", "timeframe", "timestamp",
    "rsi_14", "rsi_7", "macd_line", "macd_signal", "macd_histogram",
    "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_percent_b", "atr_14",
    "return_1bar", "return_5bar", "return_12bar", "rolling_volatility_20", "momentum_48",
    "is_london_session", "is_ny_session", "is_overlap_session", "is_asian_session",
    "hour_of_day", "day_of_week", "is_month_turn", "warmup_complete",
]


def add_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring an older layout up to ``schema``: columns it lacks appear as null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def newest_per_key(df: DataFrame, order: Column | str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: the one with the greatest ``order``. Combines on the map side."""
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_row")).select(*keys, "_row.*")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The files in the declared layout. Columns that older files lack are null; no footers are opened to plan."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("month", T.DateType())])).parquet(path)


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None, order: str | None = None) -> None:
    """Upsert: rows replace stored ones with the same key; only the touched partitions are rewritten.

    All rows of one (symbol, timeframe, month) go to one file, about 9,000 of 5-minute bars. Rows are sorted by
    time inside the file, so that time filters skip row groups. ``schema`` declares the table's columns;
    without it they are those of ``df``, and columns that only stored files have are not kept. Of rows with
    equal keys in ``df``, that with the greatest ``order`` column is taken; without one they must not occur.
    """
    spark = df.sparkSession
    target = schema or df.drop("month").schema
    new = newest_per_key(add_missing(df, T.StructType([*target.fields, *([df.schema[order]] if order and order not in target.names else [])])),
                         order or "ts")
    new = add_missing(new, target).withColumn("month", F.to_date(F.date_trunc("month", "ts")))
    if _exists(spark, path):
        touched = new.select(*PARTITIONS).distinct()
        old = _stored(spark, path, target).join(touched, list(PARTITIONS), "left_semi")
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        new = newest_per_key(both, "_new").drop("_new")
    (
        new.repartition(*PARTITIONS)
        .sortWithinPartitions(*PARTITIONS, "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table in the current schema, whatever layout its files were written in."""
    return _stored(spark, path, schema)


def range_scan(table: DataFrame, symbol: str, timeframe: str, start: datetime, end: datetime,
               ordered: bool = True) -> DataFrame:
    """Rows of one series between two times, both inclusive. Prunes partitions where there are any."""
    out = table.filter(
        (F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)
        & (F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
    if "month" in table.columns:
        # a day of slack on both sides, so that the pruning holds for any zone of start and end
        out = out.filter((F.col("month") >= F.lit((start - timedelta(days=1)).date().replace(day=1)))
                         & (F.col("month") <= F.lit((end + timedelta(days=1)).date())))
    return out.orderBy("ts") if ordered else out


def latest(df: DataFrame, keys: Sequence[str] = ("symbol", "timeframe"), ts: str = "ts") -> DataFrame:
    """The newest row of every series: a partial aggregate, no sort."""
    return newest_per_key(df, ts, keys)


def fresh(state: DataFrame, now: Column, ttl_seconds: int = 3600, updated: str = "updated_at") -> DataFrame:
    """Latest-state rows that have not expired."""
    return state.filter(F.unix_micros(now) - F.unix_micros(updated) < ttl_seconds * 1_000_000)


def forget(state: DataFrame, gone: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """State without the series listed in ``gone``."""
    return state.join(gone.select(*keys), list(keys), "left_anti")


def export_frame(features: DataFrame) -> DataFrame:
    """The columns of the feature file, in its order."""
    return features.withColumnRenamed("ts", "timestamp").select(*EXPORT_COLUMNS)


def export_features(features: DataFrame, path: str) -> None:
    export_frame(features).write.mode("overwrite").csv(
        path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ssxxx")
