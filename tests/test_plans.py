"""Guards on physical plans: what would not survive a series that holds a third of all rows."""

from __future__ import annotations

import re

import pytest
from conftest import frame, walk
from pyspark.sql import functions as F

from tidebars.operators import indicators as ind
from tidebars.operators import labels as lb
from tidebars.operators import performance as pf
from tidebars.operators import regime as rg
from tidebars.operators import resample as rs
from tidebars.operators.asof import asof_join
from tidebars.operators.crossasset import cross_asset
from tidebars.operators.features import compute_features
from tidebars.operators.index import geometric_index
from tidebars.operators.splits import walk_forward
from tidebars.operators.trades import replay
from tidebars.schema import BARS, SERIES
from tidebars.sources.tables import latest

CASES = {
    "rsi": lambda b: ind.rsi(b),
    "macd": lambda b: ind.macd(b),
    "adx": lambda b: ind.adx(b),
    "volatility": lambda b: ind.rolling_volatility(b),
    "features": lambda b: compute_features(b, positive_prices=True),
    "labels": lambda b: lb.atr_label(b),
    "folds": lambda b: walk_forward(b),
    "asof": lambda b: asof_join(b.select("symbol", "ts", "close"), b.select("symbol", "ts", "high"), ["symbol"], 300),
    "cross": lambda b: cross_asset(b, "XAUUSD", "DXY", "VIX"),
    "regime": lambda b: rg.intraday_regime(b.withColumns({"adx_14": F.lit(22.0), "atr_14": F.lit(1.0)})),
    "persist": lambda b: rg.persist(b.withColumn("proposed_state", F.lit("ranging"))),
    "trades": lambda b: replay(b.withColumn("direction", F.lit("long")), 12)[0],
    "curve": lambda b: pf.running_curve(b.withColumn("r", F.lit(0.01)), "r", SERIES, "ts", 300, True),
}
SMALL = {"_fine", "_blk", "_slice"}  # one row per 256 bars, per block or per slice


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "bars")
    frame(spark, walk(400)).write.parquet(path)
    return spark.read.schema(BARS).parquet(path)


def plan_of(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", CASES)
def test_windows_stay_within_blocks(stored, name):
    plan = plan_of(CASES[name](stored))
    windows = re.findall(r"windowspecdefinition\(([^()]*), specifiedwindowframe", plan)
    assert windows
    for spec in windows:
        columns = [c.strip().split(" ")[0] for c in spec.split(",")]
        assert SMALL & set(columns), spec
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("case", [
    lambda b: rs.resample_many(b, "5m", ["15m", "1h", "4h"]), lambda b: rs.sample_daily(b), latest,
    lambda b: geometric_index(b, {"A": 0.5, "B": -0.5}, 1.0)])
def test_aggregations_combine_before_the_shuffle(stored, case):
    plan = plan_of(case(stored))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_" in plan and "Window" not in plan
    assert "SortMergeJoin" not in plan and "ObjectHashAggregate" not in plan


def test_scans_read_only_what_is_needed(stored):
    plan = plan_of(ind.bollinger(stored.filter(F.col("symbol") == "XAUUSD")).select("ts", "bb_middle"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("open" not in s and "volume" not in s for s in schemas)
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,XAUUSD)" in plan
