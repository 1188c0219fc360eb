"""Stacked classifier on pyspark.ml: boosted trees on rows, a network on windows, trees over both.

Rows of any number of series train one model together; filter to one series for a model of its own.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.bars import feature_array, holding_period
from tidebars.operators.labels import chronological_position, fit_scaler, sequences
from tidebars.operators.performance import BAR_PERIODS, fold_metrics
from tidebars.operators.splits import walk_forward
from tidebars.operators.trades import signal_rule
from tidebars.operators.trees import TreeTable
from tidebars.schema import FEATURE_COLUMNS, SERIES, timeframe_minutes
from tidebars.session import materialize

KEY = [*SERIES, "ts"]
MIN_LABELED = 200


@dataclass(frozen=True)
class EnsembleConfig:
    """Fixed values of the models; ``light`` gives a quick variant for tests and demonstrations."""

    base_trees: int = 300
    base_depth: int = 6
    base_rate: float = 0.05
    meta_trees: int = 100
    meta_depth: int = 3
    meta_rate: float = 0.1
    lookback: int = 48
    hidden: int = 16
    network_iterations: int = 100
    train_share: float = 0.70
    neutral_threshold: float = 0.55
    high_threshold: float = 0.70
    horizon: int = 24
    seed: int = 42

    def light(self, lookback: int = 12) -> "EnsembleConfig":
        return replace(self, base_trees=5, base_depth=3, meta_trees=5, meta_depth=2, lookback=lookback, hidden=4,
                       network_iterations=15)


def _literals(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass
class Ensemble:
    """The fitted parts. ``means`` and ``scales`` are those of the 24 model inputs."""

    config: EnsembleConfig
    means: list[float]
    scales: list[float]
    base: GBTClassificationModel
    sequence: MultilayerPerceptronClassificationModel
    meta: GBTClassificationModel | None = None

    def inputs(self, rows: DataFrame) -> DataFrame:
        """``features`` (vector), and the standardized values as an array."""
        scaled = F.zip_with(feature_array(), F.zip_with(_literals(self.means), _literals(self.scales), lambda m, s: F.struct(
            m.alias("m"), s.alias("s"))), lambda x, p: (x - p["m"]) / p["s"])
        return rows.withColumns({"features": array_to_vector(feature_array()), "_scaled": scaled})

    def with_base(self, rows: DataFrame) -> DataFrame:
        return _probabilities(self.base, rows, "features", "base")

    def with_sequence(self, rows: DataFrame, keep_short: bool = False) -> DataFrame:
        """Probabilities from the last ``lookback`` rows; rows with fewer are dropped or get one half each."""
        n = self.config.lookback
        windows = sequences(rows, n, vector="_scaled", name="_window")
        scored = _probabilities(self.sequence, windows.withColumn("_flat", array_to_vector(F.flatten("_window"))),
                                "_flat", "sequence").drop("_window", "_flat")
        if not keep_short:
            return scored
        probs = scored.select(*KEY, "sequence_short", "sequence_long")
        return rows.join(probs, KEY, "left").na.fill(0.5, ["sequence_short", "sequence_long"])

    def score(self, rows: DataFrame, keep_short: bool = False) -> DataFrame:
        """prob_short and prob_long of the whole ensemble, next to those of its parts."""
        both = self.with_sequence(self.with_base(self.inputs(rows)), keep_short)
        stacked = both.withColumn("_stack", _stack())
        out = _probabilities(self.meta, stacked, "_stack", "prob")
        return out.drop("_stack", "_scaled")

    def signals(self, scored: DataFrame) -> DataFrame:
        """Direction, confidence, tier and holding period from scored rows."""
        direction, confidence = signal_rule(F.col("prob_long"), F.col("prob_short"), self.config.neutral_threshold)
        return scored.withColumns({
            "direction": direction, "confidence": confidence,
            "predicted_horizon": holding_period(F.lit(self.config.horizon)),
            "base_prob": F.col("base_long"), "sequence_prob": F.col("sequence_long"), "ensemble_prob": F.col("prob_long"),
        }).withColumn("high_confidence", F.col("confidence") > self.config.high_threshold)

    def attributions(self, rows: DataFrame, top: int = 5) -> DataFrame:
        """What each input adds to the base probability: the change when it is set to its mean.

        A row's 24 variants are worked out where it lies, from the table of the trees' nodes.
        """
        keyed = rows.select(*KEY, feature_array().alias("_inputs"))
        return TreeTable.of_model(self.base).attributions(keyed, KEY, "_inputs", FEATURE_COLUMNS, self.means, top)

    def save(self, path: str) -> None:
        """Parts as pyspark.ml models, numbers as one JSON record. No pickles."""
        spark = SparkSession.active()
        for name in ("base", "sequence", "meta"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        record = json.dumps({"config": asdict(self.config), "means": self.means, "scales": self.scales})
        spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")

    @classmethod
    def load(cls, path: str) -> "Ensemble":
        record = json.loads(SparkSession.active().read.text(f"{path}/record").first()["value"])
        return cls(EnsembleConfig(**record["config"]), record["means"], record["scales"],
                   GBTClassificationModel.load(f"{path}/base"),
                   MultilayerPerceptronClassificationModel.load(f"{path}/sequence"),
                   GBTClassificationModel.load(f"{path}/meta"))


def _stack() -> Column:
    return array_to_vector(F.array("base_short", "base_long", "sequence_short", "sequence_long"))


def _probabilities(model, rows: DataFrame, features: str, prefix: str) -> DataFrame:
    """Run a classifier and keep its two probabilities as plain columns."""
    model = model.copy().setFeaturesCol(features).setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
    p = vector_to_array("_p")
    return model.transform(rows).withColumns({f"{prefix}_short": p[0], f"{prefix}_long": p[1]}).drop("_p", "_r", "_y")


def fit_ensemble(rows: DataFrame, config: EnsembleConfig = EnsembleConfig()) -> Ensemble:
    """Base models on the first 70 % of every series, the meta model on their results for the rest."""
    c = config
    placed = materialize(chronological_position(rows.select(*KEY, *FEATURE_COLUMNS, "label")))
    early = F.col("position") < F.floor(F.col("series_rows") * c.train_share)
    train, later = placed.filter(early), placed.filter(~early)
    stats = {r["feature"]: r for r in fit_scaler(train, FEATURE_COLUMNS).collect()}  # 24 rows
    means = [stats[f]["mean"] or 0.0 for f in FEATURE_COLUMNS]
    scales = [stats[f]["scale"] or 1.0 for f in FEATURE_COLUMNS]
    counts = train.agg(F.count_if(F.col("label") == 1).alias("long"), F.count_if(F.col("label") == 0).alias("short")).first()
    weight = counts["short"] / counts["long"] if counts["long"] else 1.0
    fitted = Ensemble(c, means, scales, None, None)
    prepared = fitted.inputs(train).withColumn("_weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    fitted.base = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="_weight", maxIter=c.base_trees, maxDepth=c.base_depth,
        stepSize=c.base_rate, seed=c.seed).fit(prepared)
    windows = sequences(prepared, c.lookback, vector="_scaled").select(
        "label", array_to_vector(F.flatten("sequence")).alias("features"))
    fitted.sequence = MultilayerPerceptronClassifier(
        layers=[c.lookback * len(FEATURE_COLUMNS), c.hidden, 2], maxIter=c.network_iterations, seed=c.seed,
        labelCol="label").fit(windows)
    stacked = fitted.with_sequence(fitted.with_base(fitted.inputs(later))).select("label", _stack().alias("features"))
    fitted.meta = GBTClassifier(featuresCol="features", labelCol="label", maxIter=c.meta_trees, maxDepth=c.meta_depth,
                                stepSize=c.meta_rate, seed=c.seed).fit(stacked)
    return fitted


def evaluate_fold(model: Ensemble, test: DataFrame) -> DataFrame:
    """Predictions on test rows: the ensemble, or the base alone for series too short for a window."""
    prepared = materialize(model.with_base(model.inputs(test)))
    whole = _probabilities(model.meta, model.with_sequence(prepared).withColumn("_stack", _stack()), "_stack", "prob")
    whole = whole.select(*KEY, "label", "forward_return", "base_long", F.col("prob_long").alias("p"))
    short = prepared.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < model.config.lookback)
    alone = prepared.join(short.select(*SERIES), list(SERIES), "left_semi").select(
        *KEY, "label", "forward_return", "base_long", F.col("base_long").alias("p"))
    return whole.unionByName(alone).withColumn("prediction", (F.col("p") > 0.5).cast("double"))


def train_run(dataset: DataFrame, config: EnsembleConfig = EnsembleConfig(), folds: int = 5) -> tuple[Ensemble, DataFrame]:
    """(final ensemble, one row of metrics per series and fold) of a walk-forward run.

    ``dataset`` has features, label and forward_return. The loop runs over a handful of folds; each
    fit and evaluation is a distributed job on the stored dataset.
    """
    total = dataset.count()
    if total < MIN_LABELED:
        raise ValueError(f"need at least {MIN_LABELED} labelled rows, got {total}")
    placed = materialize(walk_forward(dataset, folds, purge=config.horizon))
    timeframe = placed.select("timeframe").first()["timeframe"]
    results = None
    for i in range(folds):
        fold = placed.filter(F.col("fold") == i)
        train, test = (fold.filter(F.col("role") == r).drop("fold", "role", "position") for r in ("train", "test"))
        model = fit_ensemble(train, config)
        scored = materialize(evaluate_fold(model, test).withColumn("fold", F.lit(i)))
        keys = [*SERIES, "fold"]
        metrics = fold_metrics(scored, keys, timeframe_minutes(timeframe) * 60, config.horizon, BAR_PERIODS)
        baseline = model.with_base(model.inputs(test)).groupBy(*SERIES).agg(
            F.avg(((F.col("base_long") > 0.5).cast("double") == F.col("label")).cast("double")).alias("base_only_accuracy"))
        sizes = fold.groupBy(*SERIES).agg(F.count_if(F.col("role") == "train").alias("train_size"),
                                          F.count_if(F.col("role") == "test").alias("test_size"))
        row = materialize(metrics.join(baseline, list(SERIES)).join(sizes, list(SERIES)))
        results = row if results is None else results.unionByName(row)
    return fit_ensemble(dataset, config), results


def run_summary(results: DataFrame) -> DataFrame:
    return results.groupBy(*SERIES).agg(
        F.avg("sharpe_ratio").alias("mean_sharpe"), F.avg("win_rate").alias("mean_win_rate"),
        F.max("max_drawdown").alias("worst_drawdown"), F.count(F.lit(1)).alias("folds"))


def save_run(model: Ensemble, results: DataFrame, path: str, **facts: str) -> None:
    """Model, fold results and summary; ``facts`` (symbol, period, ...) go into the summary record."""
    model.save(f"{path}/model")
    results.write.mode("overwrite").parquet(f"{path}/folds")
    run_summary(results).withColumns({k: F.lit(v) for k, v in facts.items()}).write.mode("overwrite").json(f"{path}/summary")
