from __future__ import annotations

from datetime import datetime, timedelta

import loops
import numpy as np
import pandas as pd
import pytest
from conftest import collect, frame, same, walk
from pyspark.sql import functions as F

from tidebars.operators import ledger as lg
from tidebars.operators import online as on
from tidebars.operators import rewards as rw
from tidebars.schema import DECISIONS, SERIES


def decisions(spark, actions, closes, episode=1, regime="ranging"):
    rows = [(episode, i + 1, datetime(2024, 1, 2) + timedelta(minutes=5 * i), a, float(c), 3.5, 55.0, regime)
            for i, (a, c) in enumerate(zip(actions, closes))]
    return spark.createDataFrame(rows, DECISIONS)


def replay(actions, closes, c):
    """Account followed step by step."""
    half, size = c.lot_size * c.commission_per_lot / 2, c.lot_size * c.units_per_lot
    balance = peak = c.initial_balance
    position, entry, held, trades, out = 0, 0.0, 0, 0, []
    sign = {0: 0, 1: 1, 2: -1}
    n = min(len(actions), c.episode_length or len(actions))
    for i in range(n):
        a, px, real, closed = actions[i], closes[i], 0.0, False
        if a != position:
            if position:
                real = sign[position] * (px - entry) * size - half
                balance, trades, closed, held = balance + real, trades + 1, True, 0
            if a:
                balance, entry, held = balance - half, px, 0
            position = a
        unreal = sign[position] * (px - entry) * size
        liquidated = False
        if position:
            held += 1
            peak = max(peak, balance + unreal)
            liquidated = balance + unreal <= px * size / c.leverage * c.margin_call_pct / 100
        last = liquidated or i == n - 1
        if last and position:
            real, balance, trades, closed = real + unreal - half, balance + unreal - half, trades + 1, True
            position, unreal, held = 0, 0.0, 0
        out.append((position, real, unreal, balance, peak, (peak - balance - unreal) / peak * 100, held, trades, closed, liquidated))
        if last:
            break
    return pd.DataFrame(out, columns=["position", "realized_pnl", "unrealized_pnl", "balance", "peak_equity", "drawdown_pct",
                                      "bars_held", "total_trades", "trade_closed", "is_liquidated"])


@pytest.mark.parametrize("n, lots, seed, limit", [(200, 0.01, 1, 2016), (6000, 0.05, 2, None), (300, 3.0, 3, 2016), (100, 0.01, 4, 40)])
def test_ledger(spark, n, lots, seed, limit):
    rng = np.random.default_rng(seed)
    actions = np.repeat(rng.integers(0, 3, n), rng.integers(1, 6, n))[:n].tolist()
    closes = np.round(2000 + np.cumsum(rng.normal(0, 2, n)), 2).tolist()
    config = lg.AccountConfig(lot_size=lots, episode_length=limit)
    got = lg.account_ledger(decisions(spark, actions, closes), config).orderBy("step").toPandas()
    want = replay(actions, closes, config)
    assert len(got) == len(want)
    for c in want.columns:
        same(got[c].astype(float), want[c].astype(float), 1e-7)
    assert got["episode_end"].tolist() == [False] * (len(want) - 1) + [True]
    if seed == 3:
        assert want["is_liquidated"].iloc[-1]


def test_ledger_config():
    for bad in (dict(leverage=0), dict(commission_per_lot=-1), dict(margin_call_pct=101), dict(episode_length=0)):
        with pytest.raises(ValueError):
            lg.AccountConfig(**bad)


def test_rewards_by_hand(spark):
    actions, closes = [1, 1, 2, 0, 0], [2000.0, 2010.0, 2005.0, 2005.0, 2001.0]
    config = lg.AccountConfig(lot_size=1.0)
    book = lg.account_ledger(decisions(spark, actions, closes), config)
    plain = rw.pnl_reward(book).orderBy("step").toPandas()["reward"].tolist()
    assert plain == pytest.approx([0.0, 500.0, 500.0 - 3.5, -3.5, -0.0001])
    scaled = rw.pnl_reward(book, rw.PnlWeights(by_atr=True)).orderBy("step").toPandas()["reward"].tolist()
    assert scaled == pytest.approx([0.0, 500 / 0.35, 496.5 / 0.35, -3.5 / 0.35, -0.0001])
    rows = rw.risk_reward(book).orderBy("step").toPandas()
    dd = rows["drawdown_pct"]
    base = np.array(plain) - np.where(dd > 0.02, (dd - 0.02) * 10, 0)
    assert rows["reward"].tolist() == pytest.approx((base + [-0.12, -0.1, -0.12, -0.02, 0]).tolist())
    both = rw.apply_rewards(book, a=rw.pnl_reward, b=rw.risk_reward)
    assert {"a", "b"} <= set(both.columns) and "reward" not in both.columns
    market = spark.createDataFrame([("A", "5m", datetime(2024, 1, 2), 9.0, "low_vol_trend"), ("B", "5m", datetime(2024, 1, 2), 8.0, "ranging")],
                                   "symbol string, timeframe string, ts timestamp, atr_14 double, regime_state string")
    own = book.withColumns({"symbol": F.lit("A"), "timeframe": F.lit("5m")})
    context = rw.reward_context(own, market, config).orderBy("step").collect()
    assert len(context) == len(actions)
    assert (context[0].atr_14, context[1].atr_14, context[0].margin_per_lot) == (9.0, None, 2000.0)


def test_sharpe_reward(spark):
    rng = np.random.default_rng(8)
    balance = 10_000 * np.cumprod(1 + rng.normal(0, 0.02, 400))
    rows = [(1, i + 1, float(b)) for i, b in enumerate(balance)]
    got = rw.sharpe_reward(spark.createDataFrame(rows, "episode_id long, step int, balance double")).orderBy("step").toPandas()["reward"]
    a = b = 0.0
    want = [0.0]
    for i in range(1, 400):
        r = balance[i] / balance[i - 1] - 1
        v = b - a * a
        value = 0.0 if i <= 20 or v < 1e-6 else np.clip(100 * (b * (r - a) - 0.5 * a * (r * r - b)) / (v ** 1.5 + 1e-8), -1, 1)
        want.append(value)
        a, b = a + 0.01 * (r - a), b + 0.01 * (r * r - b)
    same(got, want, 1e-7)


def test_episodes(spark):
    rows = frame(spark, walk(500)).select(*SERIES, "ts", "close")
    starts = lg.episode_starts(rows, 50, 20)
    assert starts.count() == 20 and starts.filter("start < 0 OR start > 449").count() == 0
    got = lg.episode_rows(rows, starts, 50).groupBy("episode_id").agg(F.count("*").alias("n"), F.max("step").alias("m")).collect()
    assert {(r.n, r.m) for r in got} == {(51, 50)} and len(got) == 20
    assert starts.collect() == lg.episode_starts(rows, 50, 20).collect()
    assert lg.episode_rows(rows, lg.evaluation_starts(rows), None).agg(F.max("step")).first()[0] == 499
    with pytest.raises(Exception, match="too few rows"):
        lg.episode_starts(rows, 500, 1).collect()


def test_online_scores_over_blocks(spark):
    pdf = walk(9000)
    rng = np.random.default_rng(6)
    pdf["close"] = rng.normal(0, 1, 9000) + np.where(rng.random(9000) < 0.01, 40, 0)
    pdf["ts"] = pdf["ts"] + pd.to_timedelta(np.where(np.arange(9000) >= 4000, 600, 0), unit="m")
    rows = frame(spark, pdf).withColumn("v", F.array("close", "volume"))
    got = collect(on.running_scores(rows, "v", [False, True], SERIES), "_z")
    minutes = pdf["ts"].astype("datetime64[s]").astype("int64") / 60
    same([z[0] for z in got["_z"]], loops.online_scores(pdf["close"].to_numpy(), minutes.to_numpy()), 1e-8)
    same([z[1] for z in got["_z"]], loops.online_scores(np.log(pdf["volume"].to_numpy()), minutes.to_numpy()), 1e-8)


def test_online_scores_repair_seams(spark):
    """With a run-in far too short to forget, the seam check has to run blocks again."""
    pdf = walk(5000)
    rows = frame(spark, pdf).withColumn("v", F.array("close"))
    got = collect(on.running_scores(rows, "v", [False], SERIES, block_rows=1024, burn_in=25), "_z")
    same([z[0] for z in got["_z"]], loops.online_scores(pdf["close"].to_numpy(), np.arange(5000) * 5.0), 1e-7)


def test_online_scores_repair_takes_few_turns(spark, monkeypatch):
    """Where every seam of 18 blocks disagrees, turns do not grow with the blocks, and each writes what it redoes."""
    pdf = walk(9000)
    redone, retrace = [], on._retrace

    def counted(rows, runs, *rest):
        redone.append(runs.count())
        return retrace(rows, runs, *rest)

    monkeypatch.setattr(on, "_retrace", counted)
    rows = frame(spark, pdf).withColumn("v", F.array("close"))
    got = collect(on.running_scores(rows, "v", [False], SERIES, block_rows=512, burn_in=25), "_z")
    assert len(got) == 9000
    same([z[0] for z in got["_z"]], loops.online_scores(pdf["close"].to_numpy(), np.arange(9000) * 5.0), 1e-9)
    assert 1 <= len(redone) <= 3 and redone[0] >= 15


def test_seam_runs(spark):
    """Unbroken runs begin with what the block before them ends with; later turns take following blocks along."""
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    state = lambda m: [30.0, m, 1.0]
    made = [("a", 0, state(0.0), state(1.0)), ("a", 1, state(9.0), state(2.0)), ("a", 2, state(9.0), state(3.0)),
            ("a", 3, state(3.0), state(4.0)), ("a", 4, state(4.0), state(5.0)), ("a", 5, state(9.0), state(6.0)),
            ("b", 0, state(0.0), state(1.0)), ("b", 1, state(1.0), state(2.0))]
    ends = spark.createDataFrame([(*row, at) for row in made],
                                 f"symbol string, {on.BLOCK} long, _begin array<double>, _end array<double>, _last timestamp")
    found = lambda ahead: {(r["symbol"], r[on.BLOCK], r["_run"], tuple(r["_given"] or ()))
                           for r in on._runs(ends, ["symbol"], ahead).collect()}
    assert found(0) == {("a", 1, 1, (30.0, 1.0, 1.0)), ("a", 2, 1, ()), ("a", 5, 5, (30.0, 5.0, 1.0))}
    assert found(1) == found(0) | {("a", 3, 1, ())}
    assert found(3) == {("a", 1, 1, (30.0, 1.0, 1.0)), *[("a", i, 1, ()) for i in (2, 3, 4, 5)]}


def test_feature_specific_classes(spark):
    pdf = walk(60)
    layout = ["rsi_14", "return_1bar", "is_asian_session", "macd_line", "bb_width", "hour_of_day"]
    rows = frame(spark, pdf).select(*SERIES, "ts", "close", (F.col("close") / 1000).alias("vol")).withColumn(
        "observation", F.array(F.lit(75.0), F.lit(3.0), F.lit(1.0), F.col("close"), F.col("close"), F.lit(23.0)))
    got = collect(on.normalize_vectors(rows, layout, "feature_specific", volatility="vol", keys=SERIES), "normalized", "vol")
    z = loops.online_scores(pdf["close"].to_numpy(), np.arange(60) * 5.0)
    logs = loops.online_scores(np.log(pdf["close"].to_numpy()), np.arange(60) * 5.0)
    for i, v in enumerate(got["normalized"]):
        assert v[0] == 0.75 and v[2] == 1.0 and v[5] == 1.0
        assert v[1] == pytest.approx(3.0 if i == 0 else 3.0 / got["vol"][i - 1])
        assert v[3] == pytest.approx(np.clip(z[i], -5, 5)) and v[4] == pytest.approx(np.clip(logs[i], -5, 5))
    assert on.column_classes(["rsi_14", "bb_percent_b", "close"], "online_zscore") == ["zscore", "passthrough", "zscore"]
    with pytest.raises(ValueError):
        on.column_classes(["x"], "other")
    apart = collect(on.normalize_vectors(rows, layout, "online_zscore", session_aware=True, keys=SERIES), "normalized")
    assert len(apart) == 60


def test_position_features(spark):
    book = lg.account_ledger(decisions(spark, [1, 1, 0], [2000.0, 2010.0, 2010.0]))
    got = lg.with_position_features(book.withColumn("observation", F.array(F.lit(0.5)))).orderBy("step").toPandas()
    assert [list(v) for v in got["observation"]] == [[0.5, 1.0, 0.0], [0.5, 1.0, 0.001], [0.5, 0.0, 0.0]]
