"""Registered queries: labels, folds, regimes, trades and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.records import from_record, to_record, topic
from tidebars.operators import hmm as hs
from tidebars.operators import indicators as ind
from tidebars.operators import labels as lb
from tidebars.operators import performance as pf
from tidebars.operators import regime as rg
from tidebars.operators import splits as sp
from tidebars.operators.changepoint import with_change_points
from tidebars.operators.gated import replay_while_flat
from tidebars.operators.trades import replay, replay_grid, signal_rule
from tidebars.plans.common import rounded
from tidebars.schema import REGIME, SERIES, SIGNALS
from tidebars.session import materialize
from tidebars.sources.driver_tables import event_bars, order_bars
from tidebars.sources.tables import add_missing

STEP = 3600
LIFT = 1500.0


def labels_sign(spark: SparkSession, folder: str) -> DataFrame:
    return lb.sign_label(event_bars(spark, folder, "5m")).select("symbol", "ts", "label")


def labels_atr(spark: SparkSession, folder: str) -> DataFrame:
    return lb.atr_label(event_bars(spark, folder, "5m"), 12, 0.5).select("symbol", "ts", "label")


def forward_return(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(lb.forward_return(event_bars(spark, folder, "5m")).select("symbol", "ts", "forward_return"))


def _small_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with a few features and a label, as a stand-in for the full feature table."""
    bars = ind.log_returns(event_bars(spark, folder, "1h"))
    return lb.sign_label(bars, 6).filter("label IS NOT NULL").na.drop(subset=["return_1bar", "return_5bar", "return_12bar"])


def flat_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows of features joined to bars, with forward returns."""
    bars = event_bars(spark, folder, "5m")
    features = ind.log_returns(bars).drop("open", "high", "low", "close", "volume", "is_complete")
    joined = lb.sign_label(features.join(bars.select(*SERIES, "ts", "close"), [*SERIES, "ts"]))
    kept = joined.filter("label IS NOT NULL").na.drop(subset=["return_1bar", "return_5bar", "return_12bar"])
    return rounded(lb.attach_returns(kept, bars).select("symbol", "ts", "return_12bar", "label", "forward_return"))


def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["return_1bar", "return_5bar", "return_12bar"]
    rows = _small_dataset(spark, folder).select(*SERIES, "ts", *columns)
    return rounded(lb.apply_scaler(rows, lb.fit_scaler(rows, columns), columns).select("symbol", "ts", *columns), 5)


def sequence_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 48 rows, reported by their ends and sums."""
    bars = event_bars(spark, folder, "5m").withColumn("_x", F.array("close", "volume"))
    seq = lb.sequences(bars, 48, vector="_x")
    return rounded(seq.select(
        "symbol", "ts", F.size("sequence").alias("length"), F.col("sequence")[0][0].alias("first_close"),
        F.col("sequence")[47][0].alias("last_close"),
        F.aggregate(F.transform("sequence", lambda v: v[1]), F.lit(0.0), lambda a, x: a + x).alias("volume_sum")))


def walk_forward_folds(spark: SparkSession, folder: str) -> DataFrame:
    return sp.walk_forward(event_bars(spark, folder, "5m").select(*SERIES, "ts")).select(
        "symbol", "ts", "fold", "role")


def cpcv_folds(spark: SparkSession, folder: str) -> DataFrame:
    return sp.purged_combinations(event_bars(spark, folder, "5m").select(*SERIES, "ts")).select(
        "symbol", "ts", "fold", "role")


def _scored_folds(spark: SparkSession, folder: str) -> DataFrame:
    """A momentum rule as predictions on the test rows of five folds."""
    bars = _lifted(ind.log_returns(event_bars(spark, folder, "1h")))
    rows = lb.forward_return(lb.sign_label(bars, 6), 6).filter("label IS NOT NULL AND return_5bar IS NOT NULL")
    rows = rows.withColumn("prediction", F.when(F.col("return_5bar") > 0, 1.0).otherwise(0.0))
    keep = rows.select(*SERIES, "ts", "prediction", "label", "forward_return")
    return materialize(sp.walk_forward(materialize(keep)).filter("role = 'test'"))


def fold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = pf.fold_metrics(_scored_folds(spark, folder), ["symbol", "timeframe", "fold"], STEP, horizon=6)
    return rounded(out.drop("timeframe"), 5)


def acceptance(spark: SparkSession, folder: str) -> DataFrame:
    """Minimum and target gates per fold, with each threshold's own outcome."""
    m = pf.fold_metrics(_scored_folds(spark, folder), ["symbol", "timeframe", "fold"], STEP, horizon=6)
    return m.select("symbol", "fold", pf.meets(pf.MINIMUM).alias("meets_minimum"), pf.meets(pf.TARGET).alias("meets_target"),
                    *[pf.meets({k: v}).alias(f"ok_{k}") for k, v in pf.MINIMUM.items()])


def drawdown(spark: SparkSession, folder: str) -> DataFrame:
    """Additive and compound curves of the 5-minute simple returns."""
    r = lb.forward_return(_lifted(event_bars(spark, folder, "5m")), 1).withColumnRenamed("forward_return", "r")
    add = pf.running_curve(r.select(*SERIES, "ts", "r"), "r", SERIES, "ts", 300, compound=False)
    mul = pf.running_curve(r.select(*SERIES, "ts", "r"), "r", SERIES, "ts", 300, compound=True)
    both = add.select(*SERIES, "ts", F.col("drawdown").alias("additive")).join(
        mul.select(*SERIES, "ts", F.col("drawdown").alias("compound")), [*SERIES, "ts"])
    return rounded(both.select("symbol", "ts", "additive", "compound"))


def intraday_regime(spark: SparkSession, folder: str) -> DataFrame:
    bars = event_bars(spark, folder, "1h")
    rows = materialize(ind.adx(ind.atr(bars)))
    return rounded(rg.intraday_regime(rows).select("symbol", "ts", "intraday_state", "intraday_conf", "atr_expanding"))


def regime_persistence(spark: SparkSession, folder: str) -> DataFrame:
    """Proposals from the size of each 5-minute bar, held until the third that differs."""
    bars = event_bars(spark, folder, "5m")
    proposed = F.when(F.col("close") > 120, "high_vol_trend").when(F.col("close") > 40, "low_vol_trend").otherwise("ranging")
    return rg.persist(bars.withColumn("proposed_state", proposed)).select("symbol", "ts", "proposed_state", "state")


def change_points(spark: SparkSession, folder: str) -> DataFrame:
    out = with_change_points(event_bars(spark, folder, "5m"))
    return out.select("symbol", "ts", "change_points", "recent_change")


def regime_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Full decisions at 1h with the daily hidden states of the order series standing in as daily context."""
    bars = materialize(ind.atr(event_bars(spark, folder, "1h")))
    out = rg.classify(bars)
    return rounded(out.select(
        "symbol", "ts", "state", "confidence", "position_multiplier", "should_trade", "reason", "hmm_prob", "adx_value",
        "atr_expanding", "session_bias"))


def _gate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Vote, persistence and gate on 1h bars, with the calendar standing in for daily states and breaks."""
    rows = materialize(rg.intraday_regime(materialize(ind.adx(ind.atr(event_bars(spark, folder, "1h"))))))
    day = F.weekday("ts")
    rows = rows.withColumns({
        "hmm_state": F.when(day == 0, "low_vol_trend").when(day == 1, "high_vol_trend").when(day == 2, "ranging"),
        "hmm_prob": F.when(day <= 2, 0.9), "recent_change": F.hour("ts") % 7 == 0,
    })
    state, conf = rg.combine_votes(*[F.col(c) for c in (
        "intraday_state", "intraday_conf", "hmm_state", "hmm_prob", "recent_change")])
    return rg.decide(rg.persist(rows.withColumns({"proposed_state": state, "vote_conf": conf})))


def regime_gate(spark: SparkSession, folder: str) -> DataFrame:
    """What was voted, and what the gate makes of it."""
    out = _gate_rows(spark, folder)
    return rounded(out.select("symbol", "ts", "proposed_state", "state", "confidence", "position_multiplier",
                              "should_trade", F.col("reason").startswith("Low").alias("low"), "session_bias"))


def regime_records(spark: SparkSession, folder: str) -> DataFrame:
    """Whole decisions, reasons included, written as JSON records and read back."""
    rows = add_missing(_gate_rows(spark, folder).withColumn("adx_value", F.col("adx_14")), REGIME)
    wire = rows.select(topic("regime").alias("topic"), to_record("regime").alias("record"))
    fields = ["symbol", "ts", "state", "confidence", "position_multiplier", "should_trade", "reason", "hmm_prob", "adx_value",
              "atr_expanding", "session_bias"]
    return rounded(wire.select("topic", from_record("regime", "record").alias("d")).select("topic", *[f"d.{f}" for f in fields]))


def signal_records(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of the threshold rule with what they rest on, written as JSON records and read back."""
    up = F.coalesce((F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.5))
    direction, confidence = signal_rule(up, 1 - up)
    rows = event_bars(spark, folder, "1h").select("symbol", "timeframe", "ts", direction.alias("direction"), confidence.alias("confidence"),
                                                  F.lit("4h").alias("predicted_horizon"), up.alias("ensemble_prob"),
                                                  F.create_map(F.lit("place"), up).alias("top_features"))
    wire = add_missing(rows, SIGNALS).select(topic("signal").alias("topic"), to_record("signal").alias("record"))
    back = wire.select("topic", from_record("signal", "record").alias("s")).select("topic", "s.*")
    return rounded(back.select("topic", "symbol", "ts", "direction", "confidence", "predicted_horizon", "base_prob", "ensemble_prob",
                               F.col("top_features")["place"].alias("place"), "warmup_complete"))


def hmm_daily_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(hs.daily_features(order_bars(spark, folder)).select(
        "symbol", "ts", "realized_vol", "autocorrelation"))


def _states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    features = materialize(hs.daily_features(order_bars(spark, folder)))
    params = materialize(hs.fit_states(features))
    return params, hs.filter_states(features, params)


def hmm_states(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_states(spark, folder)[1].select("symbol", "ts", "hmm_state", "hmm_prob"), 4)


def regime_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(hs.state_report(_states(spark, folder)[1]).drop("timeframe"), 4)


def transition_report(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted transition probabilities next to how often the transitions were seen."""
    params, states = _states(spark, folder)
    seen = hs.observed_transitions(states)
    return rounded(hs.transition_matrix(params).join(seen, [*SERIES, "from_state", "to_state"], "left")
                   .na.fill(0, ["times"]).drop("timeframe"), 4)


#: A model of daily order prices, for reports that are compared with SQL: start, transitions, means, variances.
FIXED_STATES = ([0.5, 0.3, 0.2], [[0.9, 0.08, 0.02], [0.1, 0.85, 0.05], [0.05, 0.15, 0.8]],
                [[2.0, -0.3], [10.0, -0.1], [40.0, 0.1]], [[4.0, 0.05], [60.0, 0.05], [900.0, 0.1]])


def _fixed_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    features = materialize(hs.daily_features(order_bars(spark, folder)))
    start, transitions, means, variances = FIXED_STATES
    covariances = [[[v[0], 0.0], [0.0, v[1]]] for v in variances]
    params = features.select(*SERIES).distinct().withColumns({
        name: F.from_json(F.lit(str(value)), kind) for name, value, kind in (
            ("start", start, "array<double>"), ("transitions", transitions, "array<array<double>>"),
            ("means", means, "array<array<double>>"), ("covariances", covariances, "array<array<array<double>>>"))})
    params = materialize(params)
    return params, hs.filter_states(features, params)


def hmm_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Filtered states of a given model."""
    return rounded(_fixed_states(spark, folder)[1].select("symbol", "ts", "hmm_state", "hmm_prob"), 5)


def hmm_state_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(hs.state_report(_fixed_states(spark, folder)[1]).drop("timeframe"), 5)


def hmm_transition_report(spark: SparkSession, folder: str) -> DataFrame:
    """Transition probabilities of a given model next to how often the transitions were seen."""
    params, states = _fixed_states(spark, folder)
    seen = hs.observed_transitions(states)
    return rounded(hs.transition_matrix(params).join(seen, [*SERIES, "from_state", "to_state"], "left")
                   .na.fill(0, ["times"]).drop("timeframe"), 5)


def _lifted(bars: DataFrame) -> DataFrame:
    """Prices as those of a costly good: event values run down to zero, where relative changes have no bounds."""
    return bars.withColumns({c: F.col(c) + LIFT for c in ("open", "high", "low", "close")})


def _signals(spark: SparkSession, folder: str, timeframe: str) -> DataFrame:
    """A contrarian rule: long after a drop over five bars, short after a rise."""
    bars = ind.log_returns(event_bars(spark, folder, timeframe))
    side = F.when(F.col("return_5bar") < -1, "long").when(F.col("return_5bar") > 1, "short").otherwise("neutral")
    regime = F.when(F.col("volume") > 2, "high_vol_trend").otherwise("ranging")
    return bars.withColumns({"direction": side, "regime_state": regime})


def _trades(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(replay(_lifted(_signals(spark, folder, "5m")), 12, spread=0.3, regime="regime_state",
                              eligible=F.hour("ts") != 3)[0])


def trades_rule_signal(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_trades(spark, folder).select(
        "symbol", "direction", "entry_ts", "entry_price", "exit_ts", "exit_price", "bars_held", "pnl_pct", "regime_state"))


def signal_rule_query(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold rule on the place of the close within its bar, as a probability; a bar without range is neutral."""
    bars = event_bars(spark, folder, "1h")
    up = F.coalesce((F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.5))
    direction, confidence = signal_rule(up, 1 - up)
    return rounded(bars.select("symbol", "ts", direction.alias("direction"), confidence.alias("confidence")))


def _gated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """1h bars with signals and votes, the calendar standing in for daily states and breaks, and what is traded of them."""
    rows = rg.intraday_regime(materialize(ind.adx(ind.atr(_signals(spark, folder, "1h")))))
    day = F.weekday("ts")
    rows = materialize(_lifted(rows).drop("regime_state").withColumns({
        "hmm_state": F.when(day == 0, "low_vol_trend").when(day == 1, "high_vol_trend").when(day == 2, "ranging"),
        "hmm_prob": F.when(day <= 2, 0.9), "recent_change": F.hour("ts") % 7 == 0}))
    trades, checked = replay_while_flat(rows, 6, spread=0.3, eligible=F.col("adx_14").isNotNull())
    return rows, materialize(trades), checked


def gated_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Trades behind a regime that moves on only while no position is open."""
    return rounded(_gated(spark, folder)[1].select(
        "symbol", "direction", "entry_ts", "entry_price", "exit_ts", "exit_price", "bars_held", "pnl_pct", "regime_state"))


def gated_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """The report of these trades: bars, checked bars and all metrics of each symbol."""
    rows, trades, checked = _gated(spark, folder)
    bars = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars_processed"))
    seen = checked.groupBy("symbol").agg(F.count(F.lit(1)).alias("signals_generated"))
    numbers = pf.trade_metrics(trades, step=STEP).drop("timeframe")
    return rounded(bars.join(seen, "symbol").join(numbers, "symbol").withColumn("meets_minimum", pf.backtest_accepted()), 5)


def gated_by_regime(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.regime_breakdown(_gated(spark, folder)[1]).drop("timeframe"), 5)


def trade_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Trades and summed result for each horizon and spread."""
    grid = replay_grid(_signals(spark, folder, "1h"), [3, 6], [0.0, 0.3, 1.0])
    return rounded(grid.groupBy("symbol", "horizon", "spread").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl_pct").alias("pnl")), 4)


def trade_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.trade_metrics(_trades(spark, folder)).drop("timeframe"))


def metrics_by_regime(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.regime_breakdown(_trades(spark, folder)).drop("timeframe"))


def metrics_by_direction(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pf.direction_breakdown(_trades(spark, folder)).drop("timeframe"))


QUERIES = {
    f.__name__: f for f in (
        labels_sign, labels_atr, forward_return, flat_dataset, scaled_features, sequence_windows, walk_forward_folds,
        cpcv_folds, fold_metrics, acceptance, drawdown, intraday_regime, regime_persistence, change_points,
        regime_decision, regime_gate, regime_records, signal_records, hmm_daily_features, hmm_states, regime_report, transition_report, hmm_filter,
        hmm_state_report, hmm_transition_report, trades_rule_signal, gated_trades, gated_backtest, gated_by_regime,
        trade_grid, trade_metrics, metrics_by_regime, metrics_by_direction,
    )
}
QUERIES["signal_rule"] = signal_rule_query
