"""Registered queries: model training, signals and whole backtests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators import indicators as ind
from tidebars.operators.features import compute_features
from tidebars.operators.labels import attach_returns, chronological_position, sign_label
from tidebars.operators.models import EnsembleConfig, fit_ensemble, run_summary, train_run
from tidebars.operators.splits import periods_overlap
from tidebars.operators.trees import NODES, TreeTable
from tidebars.plans.common import rounded
from tidebars.plans.pipelines import backtest
from tidebars.schema import SERIES, WARMUP_BARS
from tidebars.session import materialize
from tidebars.sources.driver_tables import event_bars, order_bars

LIGHT = EnsembleConfig(horizon=6).light()


def _dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Warm labelled 1h rows; the cross-asset inputs are null here and enter as zeros."""
    bars = materialize(event_bars(spark, folder, "1h"))
    warm = compute_features(bars).filter("warmup_complete").join(bars.select(*SERIES, "ts", "close"), [*SERIES, "ts"])
    rows = sign_label(materialize(warm), LIGHT.horizon).filter("label IS NOT NULL")
    return bars, materialize(attach_returns(rows, bars, LIGHT.horizon))


def ml_signals(spark: SparkSession, folder: str) -> DataFrame:
    _, data = _dataset(spark, folder)
    model = fit_ensemble(data, LIGHT)
    out = model.signals(model.score(data, keep_short=True))
    return rounded(out.select("symbol", "ts", "direction", "confidence", "high_confidence", "predicted_horizon", "base_prob",
                              "sequence_prob", "ensemble_prob"))


def top_attributions(spark: SparkSession, folder: str) -> DataFrame:
    _, data = _dataset(spark, folder)
    model = fit_ensemble(data, LIGHT)
    top = model.attributions(data)
    return top.select("symbol", "ts", F.explode("top_features").alias("feature", "effect"))


def training_run(spark: SparkSession, folder: str) -> DataFrame:
    _, data = _dataset(spark, folder)
    return train_run(data, LIGHT, folds=2)[1]


def training_summary(spark: SparkSession, folder: str) -> DataFrame:
    _, data = _dataset(spark, folder)
    return run_summary(train_run(data, LIGHT, folds=2)[1])


#: A small model for comparisons with SQL: (tree, weight, node, feature, threshold, left, right, value).
TREES = [
    (0, 1.0, 0, 0, 0.1, 1, 2, 0.0), (0, 1.0, 1, 1, 1.5, 3, 4, 0.0), (0, 1.0, 2, -1, None, -1, -1, -0.4), (0, 1.0, 3, -1, None, -1, -1, 0.5),
    (0, 1.0, 4, 3, 11.5, 5, 6, 0.0), (0, 1.0, 5, -1, None, -1, -1, 0.25), (0, 1.0, 6, -1, None, -1, -1, -0.125),
    (1, 0.5, 0, 2, 60.0, 1, 2, 0.0), (1, 0.5, 1, 0, -0.3, 3, 4, 0.0), (1, 0.5, 2, 2, 110.0, 5, 6, 0.0), (1, 0.5, 3, -1, None, -1, -1, 0.75),
    (1, 0.5, 4, -1, None, -1, -1, 0.1), (1, 0.5, 5, -1, None, -1, -1, -0.2), (1, 0.5, 6, -1, None, -1, -1, -0.9),
    (2, 0.25, 0, 3, 6.5, 1, 2, 0.0), (2, 0.25, 1, -1, None, -1, -1, 0.6), (2, 0.25, 2, 1, 3.5, 3, 4, 0.0), (2, 0.25, 3, -1, None, -1, -1, -0.3),
    (2, 0.25, 4, -1, None, -1, -1, 0.3),
]
TREE_INPUTS, TREE_MEANS = ["return_1bar", "volume", "close", "hour"], [0.0, 2.0, 80.0, 12.0]


def _tree_rows(spark: SparkSession, folder: str) -> tuple[TreeTable, DataFrame]:
    bars = ind.log_returns(event_bars(spark, folder, "1h")).withColumn("hour", F.hour("ts"))
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in TREE_INPUTS])
    return TreeTable.of_rows(spark.createDataFrame(TREES, NODES)), bars.select("symbol", "ts", values.alias("x"))


def tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities from a table of nodes."""
    table, rows = _tree_rows(spark, folder)
    return rounded(table.scores(rows, ["symbol", "ts"], "x"))


def tree_attributions(spark: SparkSession, folder: str) -> DataFrame:
    """The two inputs that matter most for each score."""
    table, rows = _tree_rows(spark, folder)
    top = table.attributions(rows, ["symbol", "ts"], "x", TREE_INPUTS, TREE_MEANS, 2)
    return rounded(top.select("symbol", "ts", F.explode("top_features").alias("feature", "effect")))


def backtest_report(spark: SparkSession, folder: str) -> DataFrame:
    """A contrarian rule on warm 1h bars, replayed and reported."""
    bars = chronological_position(ind.log_returns(event_bars(spark, folder, "1h")))
    side = F.when(F.col("return_5bar") < -1, "long").when(F.col("return_5bar") > 1, "short").otherwise("neutral")
    signal = bars.withColumns({"direction": side, "warmup_complete": F.col("position") + 1 >= WARMUP_BARS})
    bars = bars.withColumns({p: F.col(p) + 500 for p in ("open", "high", "low", "close")})
    report = backtest(bars, signal, "1h", spread=0.3)[1]
    return report.select("symbol", "bars_processed", "start_date", "end_date", "signals_generated", "trade_count",
                         F.col("meets_minimum"))


def overlap_check(spark: SparkSession, folder: str) -> DataFrame:
    """Do the days of a series overlap a training period?"""
    spans = order_bars(spark, folder).groupBy("symbol", F.year("ts").cast("long").alias("year")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"))
    return spans.withColumn("overlaps", periods_overlap(
        F.col("start"), F.col("end"), F.lit(datetime(1996, 5, 1)), F.lit(datetime(1998, 2, 1))))


QUERIES = {
    f.__name__: f for f in (ml_signals, top_attributions, training_run, training_summary, tree_scores, tree_attributions, backtest_report, overlap_check)
}
