from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pandas as pd
import pytest
from conftest import collect, frame, walk
from pyspark.sql import functions as F

from tidebars.functions.records import exact_text, from_record, to_record
from tidebars.functions.sessions import is_month_turn, session_bias, session_class, with_time_features
from tidebars.operators import resample as rs
from tidebars.operators import validate as v
from tidebars.operators.features import compute_features
from tidebars.schema import BARS, FEATURES, RAW_BARS
from tidebars.sources.batches import merge_batches, merge_stats
from tidebars.sources.csv_bars import ColumnMapping, load_csv
from tidebars.sources.tables import export_features, range_scan, read_table, write_table

NOW = datetime(2024, 1, 2, 1)


def test_csv_formats_quarantine_and_stats(spark, tmp_path):
    stamps = ["2024-01-02 00:05:00", "2024-01-02 00:05", "2024-01-02T00:05:00", "2024-01-02T00:05:00Z",
              "2024-01-02T02:05:00+02:00", "2024-01-02T02:05:00+0200", "2024/01/02 00:05:00", "2024/1/2 0:05",
              "01/02/2024 00:05:00", "1/2/2024 00:05", "02.01.2024 00:05:00", "2.1.2024 0:05"]
    path = tmp_path / "bars.csv"
    body = "\n".join(f" {s} ,1.0, 2.0,0.5,1.5,{'' if i % 2 else 10}" for i, s in enumerate(stamps))
    path.write_text(f" Date ,Open,High, Low,Close,Vol\n{body}\nnonsense,1,2,0.5,1.5,3\n2024-01-02 00:10:00,1\n")
    got = load_csv(spark, str(path), "XAUUSD", "5m", ColumnMapping("Date", "Open", "High", "Low", "Close", "Vol"))
    bars = got.bars.toPandas()
    assert (bars["ts"] == pd.Timestamp("2024-01-02 00:05")).all() and len(bars) == len(stamps)
    assert bars["volume"].isna().sum() == len(stamps) // 2 and set(bars["high"]) == {"2.0"}
    assert got.bars.columns == RAW_BARS.fieldNames()
    stats = got.stats.first()
    assert (stats.rows_loaded, stats.rows_skipped) == (len(stamps), 2)
    assert any("nonsense" in r.error for r in got.rejects.collect())
    with pytest.raises(ValueError, match=r"\['close', 'datetime'"):
        load_csv(spark, str(path), "X")


def raw(spark, *rows):
    base = dict(ts=datetime(2024, 1, 2), open="2062.5", high="2063.2", low="2061.8", close="2062.9", volume="1250",
                symbol=None, timeframe=None)
    return spark.createDataFrame([tuple({**base, **r}[f] for f in RAW_BARS.fieldNames()) for r in rows], RAW_BARS)


@pytest.mark.parametrize("change, rule, field", [
    ({"ts": datetime(2024, 1, 2, 1, 0, 6)}, "timestamp_not_future", "timestamp"),
    ({"ts": datetime(2024, 1, 2, 0, 57)}, "timestamp_not_stale", "timestamp"),
    ({"open": "999"}, "price_bounds", "open"),
    ({"high": "1e5"}, "price_bounds", "high"),
    ({"symbol": "other", "low": "2064"}, "ohlc_consistency", "low"),
    ({"close": "2063.5"}, "ohlc_consistency", "close"),
    ({"open": "2061.0"}, "ohlc_consistency", "open"),
    ({"volume": "-1"}, "volume_non_negative", "volume"),
    ({"open": None}, "not_none", "open"),
    ({"high": "x"}, "decimal_conversion", "high"),
    ({"timeframe": "7m"}, "timeframe", "timeframe"),
    ({"open": "999", "volume": "-1"}, "price_bounds", "open"),
])
def test_first_failing_rule(spark, change, rule, field):
    rows = raw(spark, {"ts": datetime(2024, 1, 2, 0, 59), **change})
    good, bad = v.normalize_bars(rows, rules=v.LIVE_RULES, now=F.lit(NOW))
    assert good.count() == 0
    row = bad.first()
    assert (row.rule, row.field) == (rule, field)


def test_normalized_values_and_custom_rules(spark):
    rows = raw(spark, {"volume": None, "symbol": "xauusd", "timeframe": " 5M "}, {})
    good, bad = v.normalize_bars(rows, now=F.lit(NOW))
    assert bad.count() == 0 and good.columns == BARS.fieldNames()
    out = {(r.symbol, r.timeframe, r.volume) for r in good.collect()}
    assert out == {("XAUUSD", "5m", 0.0), ("XAUUSD", "1m", 1250.0)}
    small = v.predicate_rule("small_volume", "volume", F.col("volume").cast("double") < 1000)
    _, bad = v.normalize_bars(rows, rules=[*v.HISTORICAL_RULES, small], now=F.lit(NOW))
    assert [r.rule for r in bad.collect()] == ["small_volume"]


def test_symbols(spark):
    assert v.symbol_config("xauusd")["is_tradeable"] and len(v.list_symbols()) == v.symbol_table(spark).count()
    with pytest.raises(ValueError, match="DXY, DXY_FUT"):
        v.symbol_config("nope")
    profile = v.null_profile(spark.createDataFrame([(1.0, None), (None, None), (None, None)], "a double, b double"), ["a", "b"])
    assert {r.feature: r.status for r in profile.collect()} == {"a": "sparse", "b": "empty"}
    with pytest.raises(ValueError, match="b"):
        v.require_no_empty(profile)


def test_resample_by_hand_and_gaps(spark):
    pdf = walk(30).drop(index=[4])
    out = collect(rs.resample(frame(spark, pdf), "5m", "15m"), "open", "high", "low", "close", "volume", "is_complete")
    first, second = pdf.iloc[:3], pdf.iloc[3:5]
    assert out.loc[0, "open"] == first["open"].iloc[0] and out.loc[0, "close"] == first["close"].iloc[-1]
    assert out.loc[0, "high"] == first["high"].max() and out.loc[0, "low"] == first["low"].min()
    assert out.loc[0, "volume"] == first["volume"].sum() and out.loc[1, "volume"] == second["volume"].sum()
    assert out["is_complete"].tolist() == [True, False] + [True] * 8
    many = rs.resample_many(frame(spark, pdf), "5m", ["15m", "1h", "4h"], keep_source=True)
    assert {r.timeframe for r in many.select("timeframe").distinct().collect()} == {"5m", "15m", "1h", "4h"}
    for pair in (("5m", "1m"), ("1h", "15m"), ("4h", "1d")):
        with pytest.raises(ValueError):
            rs.resample(frame(spark, pdf), *pair)
    with pytest.raises(ValueError):
        rs.require_homogeneous(frame(spark, pd.concat([pdf, walk(3, "EURUSD")])))
    with pytest.raises(ValueError):
        rs.require_homogeneous(frame(spark, pdf.head(0)))


def test_sessions_and_month_turn(spark):
    days = ["2023-02-27", "2023-02-28", "2024-02-28", "2024-02-27", "2024-02-01", "2024-02-02", "2024-02-03", "2024-12-31"]
    rows = spark.createDataFrame([(datetime.fromisoformat(d),) for d in days], "ts timestamp")
    assert [r.t for r in rows.select(is_month_turn("ts").alias("t")).collect()] == [
        True, True, True, False, True, True, False, True]
    hours = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in range(24)], "ts timestamp")
    got = with_time_features(hours).withColumns({"c": session_class("ts"), "b": session_bias("ts")}).toPandas()
    assert got.index[got.is_london_session].tolist() == list(range(7, 16))
    assert got.index[got.is_asian_session].tolist() == [*range(7), 22, 23]
    assert got["b"].tolist() == [0.7] * 7 + [1.2] + [1.0] * 4 + [1.3] * 4 + [1.0] + [0.3] * 5 + [0.7] * 2
    assert (got["day_of_week"] == 0).all() and got["c"].iloc[[7, 12, 16, 22]].tolist() == ["london", "overlap", "ny", "asian"]


def test_merge_batches(spark):
    rows = [("X", "5m", datetime(2024, 1, 1), 1.0, -1.0, 2), ("X", "5m", datetime(2024, 1, 1), 2.0, 5.0, 1),
            ("X", "5m", datetime(2024, 1, 2), 3.0, None, 1)]
    merged = merge_batches(spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, close double, volume double, batch_no int"))
    got = merged.orderBy("ts").collect()
    assert [(r.close, r.volume, r.duplicates) for r in got] == [(2.0, 5.0, 1), (3.0, None, 0)]
    assert merge_stats(merged).first().rows_skipped == 1


def test_table_upsert_and_migration(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = walk(600)
    write_table(frame(spark, first), path)
    changed = first.iloc[290:].copy()
    changed["close"] = changed["close"] + 1
    write_table(frame(spark, pd.concat([changed, walk(5, "EURUSD")])), path)
    write_table(frame(spark, pd.concat([changed, walk(5, "EURUSD")])), path)
    table = read_table(spark, path, BARS)
    got = collect(table.filter("symbol = 'XAUUSD'"), "close")
    assert table.count() == 605
    assert got["close"].tolist() == first["close"].iloc[:290].tolist() + changed["close"].tolist()
    some = range_scan(table, "XAUUSD", "5m", first["ts"].iloc[10], first["ts"].iloc[20])
    assert some.count() == 11
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1].split("]")[0]
    old = frame(spark, walk(10)).drop("volume")
    old_path = str(tmp_path / "old")
    write_table(old, old_path)
    assert read_table(spark, old_path, BARS).filter("volume IS NULL").count() == 10
    write_table(frame(spark, walk(300, seed=2).tail(290)), old_path)
    assert read_table(spark, old_path, BARS).filter("volume IS NULL").count() == 10


def test_records_round_trip(spark, tmp_path):
    bars = frame(spark, walk(60).round(6))
    back = bars.select(from_record("bar", to_record("bar")).alias("r")).select("r.*")
    assert sorted(back.collect()) == sorted(bars.collect())
    features = compute_features(bars)
    again = features.select(from_record("features", to_record("features")).alias("r")).select("r.*")
    assert again.columns == FEATURES.fieldNames() and features.exceptAll(again).count() == 0
    wire = spark.createDataFrame([('{"symbol":"A","timeframe":"5m","timestamp":"2024-01-02T00:00:00+00:00"}',), ("{}",)], "v string")
    rows = wire.select(from_record("features", "v").alias("r")).collect()
    assert rows[0].r.hour_of_day == 0 and rows[0].r.is_month_turn is False and rows[1].r is None
    export_features(features, str(tmp_path / "out"))
    assert len(spark.read.csv(str(tmp_path / "out"), header=True).columns) == 27


@pytest.mark.parametrize("number, text", [
    (1.5, "1.5"), (1.23456789012345, "1.23456789012345"), (1e-9, "0.000000001"), (12345678.25, "12345678.25"), (20000000.0, "20000000"),
    (1.2345e-17, "1.2345E-17"), (1e30, "1.0E30"), (-2e7, "-20000000"), (0.0, "0.0"), (Decimal("0.123456789012345678"), "0.123456789012345678"),
])
def test_records_keep_all_digits(spark, number, text):
    """No digit of a number is lost on its way to text and back."""
    kind = "decimal(38,18)" if isinstance(number, Decimal) else "double"
    one = spark.createDataFrame([(number,)], f"n {kind}").select(exact_text(F.col("n")).alias("t"))
    got = one.select("t", F.col("t").cast("double").alias("back")).first()
    assert got["t"] == text and got["back"] == float(number)
