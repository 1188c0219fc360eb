"""Registered queries: decision ledgers, rewards, episodes and online normalization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators import ledger as lg
from tidebars.operators import rewards as rw
from tidebars.operators.blocks import number_rows
from tidebars.operators.features import compute_features
from tidebars.operators.online import PASS, RESCALE, column_classes, normalize_vectors
from tidebars.functions.bars import feature_array
from tidebars.plans.common import rounded
from tidebars.schema import FEATURE_COLUMNS, SERIES
from tidebars.session import materialize
from tidebars.sources.driver_tables import event_bars

ACCOUNT = lg.AccountConfig(lot_size=0.5)
CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    """A week of 5-minute bars of one symbol, 2,016 at most, is an episode; the last price decides the position."""
    bars = event_bars(spark, folder, "5m")
    code = F.lit(0)
    for name, value in CODES.items():
        code = F.when(F.col("symbol") == name, value).otherwise(code)
    log = bars.select(
        (code * 100 + F.floor(F.unix_seconds("ts") / 604800) % 100).cast("long").alias("episode_id"), *SERIES, "ts",
        (F.col("close") + 1500).alias("close"),
        F.when(F.col("close") < 15, 1).when(F.col("close") > 90, 2).when(F.col("close") > 60, 0)
        .otherwise(F.when(F.hour("ts") % 2 == 0, 1).otherwise(2)).alias("action"),
        F.col("open").alias("atr_14"), F.col("high").alias("rsi_14"),
        F.when(F.hour("ts") < 8, "ranging").when(F.hour("ts") < 16, "low_vol_trend").alias("regime_state"))
    numbered = number_rows(log, ["episode_id"], "ts", 300, "step")
    return numbered.withColumn("step", F.col("step").cast("int"))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return lg.account_ledger(_decisions(spark, folder), ACCOUNT)


def account_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_ledger(spark, folder).select(
        "episode_id", "step", "position", "trade_opened", "trade_closed", "realized_pnl", "unrealized_pnl", "balance",
        "equity", "peak_equity", "drawdown_pct", "margin_used", "bars_held", "total_trades", "commission_paid",
        "cumulative_realized", "is_liquidated", "episode_end"), 4)


def rewards_pnl(spark: SparkSession, folder: str) -> DataFrame:
    by_atr = rw.PnlWeights(by_atr=True)
    out = rw.apply_rewards(_ledger(spark, folder), plain=rw.pnl_reward, scaled=lambda d: rw.pnl_reward(d, by_atr))
    return rounded(out.select("episode_id", "step", "plain", "scaled"), 4)


def rewards_risk(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rw.risk_reward(_ledger(spark, folder)).select("episode_id", "step", "reward"), 4)


def rewards_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    out = rw.sharpe_reward(materialize(_ledger(spark, folder)))
    return rounded(out.select("episode_id", "step", "reward"), 5)


def position_features(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the position appended, and the margin a lot would need."""
    ledger = _ledger(spark, folder).withColumn("observation", F.array("atr_14", "rsi_14"))
    out = lg.with_position_features(ledger, ACCOUNT).withColumn("margin_per_lot", ACCOUNT.margin_per_lot(F.col("close")))
    vector = F.transform("observation", lambda x: F.round(x, 5) + 0.0)
    return rounded(out.select("episode_id", "step", vector.alias("observation"), "margin_per_lot"), 5)


def reward_context(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger steps next to the market state of their own series at their time."""
    market = event_bars(spark, folder, "5m").select(
        *SERIES, "ts", F.col("high").alias("atr_14"), F.col("low").alias("rsi_14"))
    out = rw.reward_context(_ledger(spark, folder), market, ACCOUNT)
    return rounded(out.select("episode_id", "step", "position", "balance", "drawdown_pct", "atr_14", "rsi_14",
                              "margin_per_lot"), 4)


def evaluation_episodes(spark: SparkSession, folder: str) -> DataFrame:
    bars = event_bars(spark, folder, "1h").select(*SERIES, "ts", "close")
    out = lg.episode_rows(bars, lg.evaluation_starts(bars), None)
    return out.select("symbol", "ts", "episode_id", "step", "close")


def training_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Forty overlapping episodes of 96 steps per series, at spread-out starts."""
    bars = event_bars(spark, folder, "5m").select(*SERIES, "ts", "close")
    sizes = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("episode_id", F.explode(F.sequence(F.lit(0), F.lit(39)))).select(
        *SERIES, F.col("episode_id").cast("long"), (F.col("episode_id") * 7919 % (F.col("n") - 96)).alias("start"))
    return lg.episode_rows(bars, starts, 96).select("symbol", "ts", "episode_id", "step", "close")


def random_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded random episodes: rows and time range per episode."""
    bars = event_bars(spark, folder, "5m").select(*SERIES, "ts", "close")
    rows = lg.episode_rows(bars, lg.episode_starts(bars, 96, 40), 96)
    return rows.groupBy("symbol", "episode_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _scores(spark: SparkSession, folder: str, session_aware: bool) -> DataFrame:
    bars = event_bars(spark, folder, "1h").withColumn("observation", F.array("close", "volume"))
    out = normalize_vectors(bars, ["close", "volume"], "online_zscore", session_aware=session_aware, keys=SERIES)
    return rounded(out.select("symbol", "ts", F.col("normalized")[0].alias("close_z"),
                              F.col("normalized")[1].alias("volume_z")), 5)


def online_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder, False)


def online_zscore_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder, True)


def feature_specific_norm(spark: SparkSession, folder: str) -> DataFrame:
    """All 24 features of the warm 1h rows, each by its own class."""
    rows = materialize(rounded(compute_features(event_bars(spark, folder, "1h"))).filter("warmup_complete").select(
        *SERIES, "ts", "rolling_volatility_20", feature_array().alias("observation")))
    out = normalize_vectors(rows, FEATURE_COLUMNS, "feature_specific", volatility="rolling_volatility_20", keys=SERIES)
    exact = (PASS, RESCALE)  # simple fractions of rounded inputs
    digits = [8 if kind in exact else 6 for kind in column_classes(FEATURE_COLUMNS, "feature_specific")]
    return out.select("symbol", "ts", *[
        (F.round(F.col("normalized")[i], digits[i]) + F.lit(0.0)).alias(c) for i, c in enumerate(FEATURE_COLUMNS)])


QUERIES = {
    f.__name__: f for f in (
        account_ledger, rewards_pnl, rewards_risk, rewards_sharpe, position_features, reward_context, evaluation_episodes,
        training_episodes, random_episodes, online_zscore, online_zscore_sessions, feature_specific_norm,
    )
}
