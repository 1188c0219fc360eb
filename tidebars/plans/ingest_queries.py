"""Registered queries: validation, batches, stored-table operators and records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.records import from_record, to_record, topic
from tidebars.operators import validate as v
from tidebars.operators.features import compute_features
from tidebars.plans.common import rounded
from tidebars.schema import BARS, FEATURE_COLUMNS, FEATURES
from tidebars.sources.batches import merge_batches, merge_stats
from tidebars.sources.csv_bars import ColumnMapping, load_csv, parse_datetime
from tidebars.sources.driver_tables import event_bars, read_table
from tidebars.sources.tables import add_missing, export_frame, forget, fresh, latest, range_scan, write_table
from tidebars.sources.tables import read_table as read_stored
from tidebars.streaming.replay import scratch

# the events end on 2024-01-30; a fixed "now" keeps time rules repeatable
NOW = datetime(2024, 1, 25)


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as raw text bars, with the kinds of damage the rules look for."""
    li = read_table(spark, folder, "lineitem")
    price = F.col("l_extendedprice")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    return li.select(
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(n % 11 == 0, "n/a").otherwise(price.cast("string")).alias("open"),
        F.when(n % 7 == 0, (price * 0.5).cast("string")).otherwise((price * 1.25).cast("string")).alias("high"),
        F.when(n % 13 != 0, (price * 0.75).cast("string")).alias("low"),
        price.cast("string").alias("close"),
        F.when(n % 17 == 0, F.concat(F.lit("-"), F.col("l_quantity").cast("string")))
        .otherwise(F.col("l_quantity").cast("string")).alias("volume"),
        F.when(F.col("l_returnflag") == "A", "xauusd").when(F.col("l_returnflag") == "R", "other").alias("symbol"),
        F.when(F.col("l_linestatus") == "F", " 5M ").alias("timeframe"),
    )


def _checked(spark: SparkSession, folder: str, rules) -> DataFrame:
    return v.check_bars(raw_lines(spark, folder), rules=rules, now=F.lit(datetime(1997, 6, 1)))


def _reasons(checked: DataFrame) -> DataFrame:
    return checked.groupBy(
        "symbol", F.coalesce("reject.rule", F.lit("accepted")).alias("rule"),
        F.coalesce("reject.field", F.lit("")).alias("field"),
    ).agg(F.count(F.lit(1)).alias("rows"), F.min("reject.value").alias("smallest_value"))


def validate_default(spark: SparkSession, folder: str) -> DataFrame:
    return _reasons(_checked(spark, folder, v.DEFAULT_RULES)).drop("smallest_value")


def validate_live(spark: SparkSession, folder: str) -> DataFrame:
    return _reasons(_checked(spark, folder, v.LIVE_RULES)).drop("smallest_value")


def validate_historical(spark: SparkSession, folder: str) -> DataFrame:
    return _reasons(_checked(spark, folder, v.HISTORICAL_RULES)).drop("smallest_value")


def normalized_bars(spark: SparkSession, folder: str) -> DataFrame:
    good = v.accepted(_checked(spark, folder, v.HISTORICAL_RULES))
    return rounded(good.groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("volume").alias("volume")), 4)


def unknown_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return v.unknown_symbols(event_bars(spark, folder, "5m"))


def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(v.null_profile(compute_features(event_bars(spark, folder, "1h")), FEATURE_COLUMNS))


def load_summary(spark: SparkSession, folder: str) -> DataFrame:
    bars = event_bars(spark, folder, "1h")
    return v.load_summary(bars, compute_features(bars))


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    """Three overlapping fetches of the 5-minute bars, as a pager with a safety margin would get them."""
    bars = event_bars(spark, folder, "5m")
    return bars.withColumn("batch_no", F.explode(F.when(
        F.minute("ts") >= 50, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    ).withColumn("close", F.col("close") + F.col("batch_no")).withColumn(
        "volume", F.when(F.hour("ts") == 3, F.lit(-1.0)).otherwise(F.col("volume")))


def dedupe_batches(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(merge_batches(_batches(spark, folder)).select("symbol", "ts", "close", "volume", "duplicates"))


def dedupe_stats(spark: SparkSession, folder: str) -> DataFrame:
    return merge_stats(merge_batches(_batches(spark, folder)))


def latest_bar(spark: SparkSession, folder: str) -> DataFrame:
    return latest(event_bars(spark, folder, "5m")).select("symbol", "timeframe", "ts", "open", "high", "low", "close",
                                                          "volume")


def range_scan_series(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "bars")
    write_table(event_bars(spark, folder, "5m"), path, BARS)
    return range_scan(read_stored(spark, path, BARS), "click", "5m", datetime(2024, 1, 10), datetime(2024, 1, 20)
                      ).select("symbol", "ts", "open", "high", "low", "close", "volume")


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """Newest bar per symbol, kept while younger than an hour, without the symbols that were deleted."""
    bars = event_bars(spark, folder, "5m")
    state = latest(bars).withColumn("updated_at", F.col("ts"))
    now = F.lit(bars.agg(F.max("ts")).first()[0])  # the newest bar's time
    gone = bars.filter(F.col("symbol") == "click").select("symbol", "timeframe").distinct()
    return forget(fresh(state, now), gone).select("symbol", "timeframe", "ts", "close")


def feature_export(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(export_frame(compute_features(event_bars(spark, folder, "1h"))))


def datetime_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in every accepted format and read back."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    pieces = F.coalesce(*[
        F.when(F.col("o_orderkey") % 12 == i, F.date_format("d", f)) for i, f in enumerate((
            "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'",
            "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "MM/dd/yyyy HH:mm:ss",
            "MM/dd/yyyy HH:mm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm"))
    ], F.lit("someday"))
    parsed = orders.withColumn("ts", parse_datetime(pieces))
    return parsed.select(
        "o_orderkey", "ts", F.when(F.col("ts").isNull(), "malformed").otherwise("loaded").alias("outcome"))


def csv_load(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as CSV bars with other header names and broken dates, loaded with a column mapping."""
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd.MM.yyyy HH:mm")
    price = F.col("o_totalprice")
    lines = read_table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(day).alias("Date"), price.alias("Open"),
        (price + 1).alias("High"), (price - 1).alias("Low"), price.alias("Close"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("Vol"))
    path = scratch(spark, "csv")
    lines.write.csv(path, header=True)
    loaded = load_csv(spark, path, "ORD", "1d", ColumnMapping("Date", "Open", "High", "Low", "Close", "Vol"))
    quarantine = loaded.rejects.agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error"))
    volumes = loaded.bars.agg(F.count("volume").alias("volumes"), F.count_distinct("ts").alias("days"))
    one = F.lit(1).alias("k")
    return (
        loaded.stats.select("*", one).join(quarantine.select("*", one), "k").join(volumes.select("*", one), "k")
        .select("rows_loaded", "rows_skipped", "start_date", "end_date", "n", "error", "volumes", "days"))


def table_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Bars stored, then corrected and extended by a second batch, twice; read back with a new column."""
    path = scratch(spark, "table")
    bars = event_bars(spark, folder, "1h").drop("is_complete")
    write_table(bars.filter(F.day("ts") <= 20), path, schema=BARS)
    fixed = bars.filter(F.day("ts") >= 15).withColumn("close", F.col("close") + 1)
    for _ in range(2):
        write_table(fixed, path, schema=BARS)
    return read_stored(spark, path, BARS).select("symbol", "timeframe", "ts", "close", "volume", "is_complete")


def bar_records(spark: SparkSession, folder: str) -> DataFrame:
    """Bars written as JSON records and read back."""
    bars = event_bars(spark, folder, "1h")
    wire = bars.select(topic("bar").alias("topic"), to_record("bar").alias("record"))
    return wire.select("topic", from_record("bar", "record").alias("b")).select(
        "topic", "b.symbol", "b.ts", "b.open", "b.high", "b.low", "b.close", "b.volume", "b.is_complete")


def feature_records(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows written as JSON records and read back."""
    rows = add_missing(compute_features(event_bars(spark, folder, "1h")), FEATURES)
    wire = rows.select(to_record("features").alias("record"))
    return rounded(export_frame(wire.select(from_record("features", "record").alias("f")).select("f.*")))


QUERIES = {
    f.__name__: f for f in (
        validate_default, validate_live, validate_historical, normalized_bars, unknown_symbols, null_profile,
        load_summary, dedupe_batches, dedupe_stats, latest_bar, range_scan_series, latest_state, feature_export,
        datetime_formats, csv_load, table_upsert, bar_records, feature_records,
    )
}
