from __future__ import annotations

from datetime import datetime, timedelta
from itertools import combinations

import loops
import numpy as np
import pandas as pd
import pytest
from conftest import collect, frame, same, walk
from pyspark.sql import functions as F

from tidebars.functions.bars import holding_period, holding_period_bars
from tidebars.operators import changepoint as cp
from tidebars.operators import gated
from tidebars.operators import hmm as hs
from tidebars.operators import labels as lb
from tidebars.operators import performance as pf
from tidebars.operators import regime as rg
from tidebars.operators import splits as sp
from tidebars.operators import trades as tr
from tidebars.operators.asof import asof_join
from tidebars.operators.crossasset import cross_asset
from tidebars.operators.index import coverage, geometric_index, missing_components, require_components
from tidebars.operators.observe import ObservationSpec, WindowSpec, observations
from tidebars.plans.pipelines import backtest, regime_votes
from tidebars.schema import DOLLAR_INDEX_WEIGHTS, FEATURE_COLUMNS, SERIES
from tidebars.session import materialize


def test_dollar_index(spark):
    levels = {"EURUSD": 1.1, "USDJPY": 145.0, "GBPUSD": 1.27, "USDCAD": 1.35, "USDSEK": 10.4, "USDCHF": 0.88}
    rows = []
    for i, (s, x) in enumerate(levels.items()):
        pdf = walk(20, s, seed=i)
        for c in ("open", "high", "low", "close"):
            pdf[c] = pdf[c] / 2062.5 * x
        rows.append(pdf.drop(index=[5]) if s == "USDSEK" else pdf)
    bars = frame(spark, pd.concat(rows))
    got = collect(geometric_index(bars), "open", "high", "low", "close")
    wide = {s: p.set_index("ts") for s, p in zip(levels, rows)}
    at = [t for t in wide["EURUSD"].index if t in wide["USDSEK"].index]
    value = 50.14348112 * np.prod([wide[s].loc[at, "close"] ** w for s, w in DOLLAR_INDEX_WEIGHTS.items()], axis=0)
    same(got["close"], value)
    assert ((got["low"] <= got[["open", "close"]].min(axis=1)) & (got["high"] >= got[["open", "close"]].max(axis=1))).all()
    assert collect(geometric_index(bars, close_only=True), "high")["high"].tolist() == pytest.approx(value.tolist())
    missing = missing_components(bars, list(levels)).collect()
    assert len(missing) == 1 and missing[0].missing == ["USDSEK"]
    report = coverage(bars, geometric_index(bars), list(levels)).first()
    assert report.index_bars == 19 and report.coverage == pytest.approx(19 * 6 / 119) and not report.out_of_range
    with pytest.raises(ValueError, match="NONE"):
        require_components(bars, ["EURUSD", "NONE"])


def test_cross_asset_counts_matched_bars(spark):
    base = walk(120)
    index = walk(120, "DXY", seed=2).drop(index=[0, 7, 30, 31, 32, 90])
    gauge = walk(120, "VIX", seed=3).iloc[::2]
    extra = walk(50, "DXY", seed=2, start=datetime(2024, 1, 1))
    got = collect(cross_asset(frame(spark, pd.concat([base, index, gauge, extra])), "XAUUSD", "DXY", "VIX"),
                  "dxy_return_1h", "dxy_rsi_14", "vix_level", "vix_change")

    def spread(pdf, values):
        return pd.Series(values, index=pdf["ts"]).reindex(base["ts"]).ffill().to_numpy()

    close = index["close"].to_numpy()
    same(got["dxy_return_1h"], spread(index, pd.Series(close).pct_change(12).to_numpy()))
    same(got["dxy_rsi_14"], spread(index, loops.rsi(close)))
    same(got["vix_level"], spread(gauge, gauge["close"].to_numpy()))
    same(got["vix_change"], spread(gauge, gauge["close"].pct_change(12).to_numpy()))


def test_asof_join(spark):
    left = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m)) for m in range(0, 60, 7)], "k string, ts timestamp")
    right = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m), m) for m in (7, 20, 50)], "k string, ts timestamp, v int")
    got = {r.ts.minute: r.v for r in asof_join(left, right, ["k"], 60).collect()}
    assert got == {0: None, 7: 7, 14: 7, 21: 20, 28: 20, 35: 20, 42: 20, 49: 20, 56: 50}


def test_observations_see_only_complete_higher_bars(spark):
    low = walk(200)
    low["v"] = np.arange(200.0)
    high = pd.DataFrame({"symbol": "XAUUSD", "timeframe": "1h", "ts": [low["ts"][0] + timedelta(hours=i) for i in range(17)],
                         "v": 1000 + np.arange(17.0)})
    both = pd.concat([low[["symbol", "timeframe", "ts", "v"]], high])
    rows = spark.createDataFrame(both, "symbol string, timeframe string, ts timestamp, v double")
    for c in FEATURE_COLUMNS:
        rows = rows.withColumn(c, F.col("v") if c == "rsi_14" else F.lit(0.0))
    rows = rows.withColumn("warmup_complete", (F.col("timeframe") == "1h") | (F.col("v") >= 3))
    spec = ObservationSpec("5m", (WindowSpec("5m", 2), WindowSpec("1h", 3)), regime=True)
    regime = rows.filter("timeframe = '5m' AND v > 100").selectExpr("symbol", "timeframe", "ts", "'ranging' AS state", "0.8D AS confidence")
    got = collect(observations(rows, spec, regime), "observation")
    assert got["ts"].iloc[0] == low["ts"][36] and len(got) == 164  # three complete hours
    for i, vector in zip(range(36, 200), got["observation"]):
        assert len(vector) == spec.size
        assert list(vector[:48:24]) == [i - 1, i]
        assert list(vector[48:120:24]) == [1000 + i // 12 - 3, 1000 + i // 12 - 2, 1000 + i // 12 - 1]
        assert list(vector[-4:]) == ([0, 0, 1, 0.8] if i > 100 else [0, 0, 0, 0])


def test_labels(spark):
    pdf = walk(5000)
    rows = frame(spark, pdf)
    later, close = pdf["close"].shift(-24), pdf["close"]
    want = np.where(later.isna(), np.nan, (later > close).astype(float))
    same(collect(lb.sign_label(rows), "label")["label"], want)
    same(collect(lb.forward_return(rows), "forward_return")["forward_return"], ((later - close) / close).fillna(0))
    mean = pd.Series(loops.true_ranges(*(pdf[c].to_numpy() for c in ("high", "low", "close")))).rolling(14).mean()
    move = later - close
    want = np.where(move > mean * 2, 1.0, np.where(move < -mean * 2, 0.0, np.nan))
    same(collect(lb.atr_label(rows, multiple=2.0), "label")["label"], want)
    with pytest.raises(ValueError):
        lb.require_bars(frame(spark, walk(99)))


def test_scaler_and_sequences(spark, tmp_path):
    pdf = walk(100)
    pdf["volume"] = 7.0
    rows = frame(spark, pdf)
    scaler = lb.fit_scaler(rows, ["close", "volume"])
    lb.save_scaler(scaler, str(tmp_path / "scaler"))
    got = collect(lb.apply_scaler(rows, lb.load_scaler(spark, str(tmp_path / "scaler")), ["close", "volume"]), "close", "volume")
    same(got["close"], (pdf["close"] - pdf["close"].mean()) / pdf["close"].std(ddof=0))
    assert (got["volume"] == 0).all()
    seq = collect(lb.sequences(rows.withColumn("x", F.array("close")), 48, vector="x"), "sequence")
    assert len(seq) == 53 and [v[0] for v in seq["sequence"][52]] == pdf["close"].iloc[-48:].tolist()


def test_walk_forward(spark):
    n = 5000
    got = sp.walk_forward(frame(spark, walk(n)).select(*SERIES, "ts"), purge=24).toPandas()
    size = n // 6
    for i in range(5):
        fold = got[got.fold == i]
        assert sorted(fold[fold.role == "train"].position) == list(range(size * (i + 1)))
        start = size * (i + 1) + 24
        assert sorted(fold[fold.role == "test"].position) == list(range(start, min(start + size, n)))
    for bad in (dict(splits=1), dict(train_ratio=0.4)):
        with pytest.raises(ValueError):
            sp.walk_forward(frame(spark, walk(10)), **bad)
    with pytest.raises(Exception, match="too few samples"):
        sp.walk_forward(frame(spark, walk(90))).collect()


def test_purged_combinations(spark):
    n = 203
    got = sp.purged_combinations(frame(spark, walk(n)).select(*SERIES, "ts"), embargo=0.02).toPandas()
    bounds = [(40 * g, 40 * (g + 1) if g < 4 else n) for g in range(5)]
    for i, chosen in enumerate(combinations(range(5), 2)):
        test = {k for g in chosen for k in range(*bounds[g])}
        gap = {k for g in chosen for k in [*range(max(0, bounds[g][0] - 1), bounds[g][0]), *range(bounds[g][1], min(n, bounds[g][1] + 4))]}
        fold = got[got.fold == i]
        assert set(fold[fold.role == "test"].position) == test
        assert set(fold[fold.role == "train"].position) == set(range(n)) - test - gap
    with pytest.raises(ValueError):
        sp.purged_combinations(frame(spark, walk(50)), 3, 3)


def test_persistence_over_blocks(spark):
    pdf = walk(5000)
    rng = np.random.default_rng(5)
    pdf["p"] = rng.choice(["low_vol_trend", "high_vol_trend", "ranging"], 5000, p=[0.5, 0.3, 0.2])
    rows = spark.createDataFrame(pdf[["symbol", "timeframe", "ts", "p"]], "symbol string, timeframe string, ts timestamp, p string")
    assert collect(rg.persist(rows, "p"), "state")["state"].tolist() == loops.persisted(pdf["p"])
    assert collect(rg.persist(rows, "p", block_rows=512), "state")["state"].tolist() == loops.persisted(pdf["p"])


def test_votes_and_gate(spark):
    rows = spark.createDataFrame(
        [("ranging", 0.8, "high_vol_trend", 0.9, True), ("ranging", 0.5, None, None, True), ("low_vol_trend", 0.5, "ranging", 1.0, False)],
        "s string, c double, h string, p double, ch boolean")
    state, conf = rg.combine_votes(*[F.col(c) for c in ("s", "c", "h", "p", "ch")])
    got = rows.select(state.alias("state"), conf.alias("conf")).collect()
    assert [r.state for r in got] == ["ranging", "ranging", "low_vol_trend"]
    assert [r.conf for r in got] == pytest.approx([0.48 / 0.85, 0.45, 0.5])
    gate = spark.createDataFrame([(datetime(2024, 1, 1, 18), "ranging", 0.5, True), (datetime(2024, 1, 1, 13), "low_vol_trend", 0.9, False)],
                                 "ts timestamp, state string, vote_conf double, recent_change boolean")
    late, fine = rg.decide(gate).collect()
    assert not late.should_trade and late.confidence == 0.4 and late.position_multiplier == pytest.approx(0.21)
    assert late.reason == "Late NY — declining liquidity; Low confidence (0.50 < 0.60); Recent structural break detected"
    assert fine.should_trade and fine.position_multiplier == pytest.approx(1.95)
    assert fine.reason == "low_vol_trend regime — London-NY overlap — peak liquidity"


def best_segmentation(x):
    """All segmentations on the grid, for small inputs."""
    d = (x[:, None] - x[None]) ** 2
    m = np.median(d[np.triu_indices(len(x), 1)])
    k = np.exp(-np.clip(d / (m if m > 0 else 1), 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    grid = [g for g in range(5, len(x), 5)]

    def cost(bounds):
        return sum((b - a) - k[a:b, a:b].sum() / (b - a) + 3.0 for a, b in zip(bounds, bounds[1:]))

    options = [[0, *c, len(x)] for r in range(4) for c in combinations(grid, r)]
    options = [o for o in options if min(np.diff(o)) >= 10]
    return min(options, key=cost)[1:-1]


def test_change_points(spark):
    rng = np.random.default_rng(0)
    for n, jump in ((40, 0.0), (40, 6.0), (45, 3.0)):
        x = rng.normal(0, 1, n)
        x[n // 2:] += jump
        assert cp.segment(x[None])[0] == best_segmentation(x)
    assert cp.segment(np.zeros((2, 30))) == [[], []]
    pdf = walk(160)
    steps = np.where(np.arange(160) < 80, 0.0001, 0.02) * np.where(np.arange(160) % 2, 1, -1)
    pdf["close"] = 100 * np.cumprod(1 + steps)
    got = collect(cp.with_change_points(frame(spark, pdf)), "change_points", "recent_change")
    assert not got["recent_change"].iloc[:80].any() and got["recent_change"].iloc[85:100].any()
    assert not got["recent_change"].iloc[130:].any() and len(got["change_points"].iloc[10]) == 0
    cut = collect(cp.with_change_points(frame(spark, pdf.head(100))), "recent_change")
    assert cut["recent_change"].tolist() == got["recent_change"].iloc[:100].tolist()


def test_change_points_over_blocks(spark):
    """Windows that reach over blocks and start short, bar by bar; no array per bar in any exchange."""
    rng = np.random.default_rng(8)
    pdf = walk(1100)
    pdf["close"] = 100 * np.cumprod(1 + rng.normal(0, 1, 1100) * np.where(np.arange(1100) // 60 % 2, 0.001, 0.01))
    out = cp.with_change_points(frame(spark, pdf))
    got = collect(out, "change_points", "recent_change")
    r = np.diff(pdf["close"]) / pdf["close"].to_numpy()[:-1]
    for i in [*range(15, 130, 9), *range(500, 640, 11), 1098, 1099]:
        window = r[max(0, i - cp.WINDOW):i]
        want = cp.segment(window[None])[0] if len(window) >= 2 * cp.MIN_SIZE else []
        assert list(got["change_points"].iloc[i]) == want
        assert got["recent_change"].iloc[i] == any(p > len(window) - cp.RECENT for p in want)


def forward_loop(x, start, trans, means, covs):
    out, total = [], 0.0
    for i, row in enumerate(x):
        b = np.array([np.exp(-0.5 * (row - m) @ np.linalg.inv(c) @ (row - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for m, c in zip(means, covs)])
        a = (start if i == 0 else out[-1] @ trans) * b
        total += np.log(a.sum())
        out.append(a / a.sum())
    return np.array(out), total


@pytest.mark.parametrize("kind", hs.COVARIANCES)
def test_hidden_states(kind):
    rng = np.random.default_rng(3)
    truth = np.repeat([0, 1, 2, 0], 60)
    x = np.array([[0, 0], [3, 0], [0, 3]])[truth] + rng.normal(0, 0.3, (240, 2))
    got = max((hs.fit(x, 3, kind, seed, 200, 1e-4) for seed in range(5)), key=lambda g: g["log_likelihood"])
    args = got["start"], got["transitions"], got["means"], got["covariances"]
    probs, likelihood = hs.filtered(x, *args)
    want, total = forward_loop(x, *args)
    same(probs, want, 1e-6)
    assert likelihood == pytest.approx(total) and likelihood == pytest.approx(got["log_likelihood"])
    states = probs.argmax(axis=1)
    assert all(len(set(states[truth == k])) == 1 for k in range(3))
    same(hs.filtered(x[:100], *args)[0], probs[:100], 1e-9)


def test_hidden_state_jobs(spark):
    rng = np.random.default_rng(4)
    parts = []
    for s in ("A", "B"):
        r = np.concatenate([rng.normal(0, 0.005, 150), rng.normal(0, 0.5, 100)])
        pdf = walk(250, s, "1d", minutes=1440)
        pdf["close"] = 100 * np.cumprod(1 + np.clip(r, -0.5, 0.5))
        parts.append(pdf)
    features = hs.daily_features(frame(spark, pd.concat(parts)))
    params = hs.fit_states(features, states=2, restarts=2, max_iter=50)
    assert params.count() == 2 and {r.seed for r in params.collect()} <= {42, 43}
    states = hs.filter_states(features, params)
    a = collect(states.filter("symbol = 'A'"), "hmm_state", "hmm_prob")
    assert (a["hmm_state"].iloc[20:120] == "low_vol_trend").all() and (a["hmm_state"].iloc[-80:] == "high_vol_trend").all()
    assert hs.state_report(states).count() == 4
    matrix = hs.transition_matrix(params).groupBy("symbol", "from_state").agg(F.sum("probability").alias("p")).collect()
    assert all(r.p == pytest.approx(1) for r in matrix)
    days = rg.previous_day_states(states)
    assert len(a) == 245 and days.filter("symbol = 'A'").count() == 250 - 29
    with pytest.raises(Exception, match="at least 50"):
        hs.fit_states(features.limit(40)).collect()
    names = {r.state_index: r.state for r in hs.name_states(spark.createDataFrame(
        [("s", "1d", [[0.1, 0.5], [0.9, 0.2], [0.5, -0.4]])], "symbol string, timeframe string, means array<array<double>>")).collect()}
    assert names == {0: "low_vol_trend", 1: "high_vol_trend", 2: "ranging"}


def _daily_walk(n: int, symbol: str, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    calm = (np.arange(n) // 300) % 2 == 0
    close = 1000 * np.exp(np.cumsum(np.where(calm, 0.004, 0.03) * rng.standard_normal(n)))
    pdf = walk(n, symbol, "1d", minutes=1440, start=datetime(2010, 1, 1))
    for c in ("open", "high", "low", "close"):
        pdf[c] = close
    return pdf


@pytest.mark.parametrize("covariance", ["diag", "tied"])
def test_hidden_states_over_blocks(spark, covariance):
    """Cut into several blocks, fit and filter give what one block gives, series by series."""
    features = materialize(hs.daily_features(frame(spark, pd.concat([_daily_walk(1500, "A", 1), _daily_walk(900, "B", 2), _daily_walk(290, "C", 3)]))))
    options = {"states": 2, "covariance": covariance, "restarts": 2, "max_iter": 4}
    whole = {r["symbol"]: r for r in hs.fit_states(features, **options).collect()}
    cut = hs.fit_states(features, rows=300, **options)
    assert hs.packed(features, 300).groupBy("symbol").count().filter("count > 2").count() == 2
    for r in cut.collect():
        assert (r["seed"], r["n_samples"]) == (whole[r["symbol"]]["seed"], whole[r["symbol"]]["n_samples"])
        for c in ("log_likelihood", "start", "transitions", "means", "covariances"):
            same(np.array(r[c]), np.array(whole[r["symbol"]][c]), 1e-7)
    params = materialize(hs.fit_states(features, **options))
    one, many = (collect(hs.filter_states(features, params, rows=n), "state_index", "hmm_prob") for n in (4096, 257))
    same(one["hmm_prob"], many["hmm_prob"], 1e-10)
    assert (one["state_index"] == many["state_index"]).all() and len(one) == features.count()


def test_hidden_state_parts():
    """Products, carries and sums of two blocks against one loop over all rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal((0, 0), 1, (40, 2)), rng.normal((4, 1), 2, (30, 2))])
    model = hs.Model(np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.0, 0.0], [4.0, 1.0]]), np.array([np.eye(2), np.eye(2) * 4]))
    density = np.stack([[np.exp(-0.5 * (r - m) @ np.linalg.inv(c) @ (r - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c)))
                         for m, c in zip(model.means, model.covs)] for r in x])
    alpha, total = np.empty((70, 2)), 0.0
    for i in range(70):
        a = (model.start if i == 0 else alpha[i - 1] @ model.trans) * density[i]
        alpha[i], total = a / a.sum(), total + np.log(a.sum())
    beta = np.ones((70, 2))
    for i in range(68, -1, -1):
        beta[i] = model.trans @ (density[i + 1] * beta[i + 1])
        beta[i] /= beta[i].max()
    gamma = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
    pairs = np.stack([alpha[i][:, None] * model.trans * density[i + 1] * beta[i + 1] for i in range(69)])
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    got, likelihood = hs.filtered(x, model.start, model.trans, model.means, model.covs)
    same(got, alpha)
    same([likelihood], [total], 1e-10)
    left = hs.block_sums(x[:33], model, True, model.start, beta[32])
    both = left + hs.block_sums(x[33:], model, False, alpha[32], np.ones(2))
    same(both.weight, gamma.sum(axis=0), 1e-9)
    same(both.pairs, pairs.sum(axis=0), 1e-9)
    same(both.start, gamma[0], 1e-9)
    same(hs.updated(model, both, "full").means, gamma.T @ x / gamma.sum(axis=0)[:, None], 1e-9)
    same(hs.Sums.of(both.flat(), 2).scatter, both.scatter)


def test_hidden_state_parameters_are_stored(spark, tmp_path):
    params = hs.fit_states(hs.daily_features(frame(spark, _daily_walk(120, "A", 1))), states=2, restarts=1, max_iter=3)
    hs.save_params(params, str(tmp_path / "hmm"))
    assert [r.asDict() for r in hs.load_params(spark, str(tmp_path / "hmm")).collect()] == [r.asDict() for r in params.collect()]
    assert hs.filter_states(hs.daily_features(frame(spark, _daily_walk(60, "A", 1))), params.limit(0)).count() == 0


def test_full_decisions(spark):
    pdf = walk(300)
    rows = frame(spark, pdf).withColumn("atr_14", F.lit(2.0))
    states = spark.createDataFrame([("XAUUSD", datetime(2024, 1, 2).date(), "ranging", 0.9)], "symbol string, day date, hmm_state string, hmm_prob double")
    got = collect(rg.classify(rows, states), "state", "should_trade", "hmm_prob", "adx_value", "reason")
    assert len(got) == 300 and got["hmm_prob"].notna().sum() == 288
    same(got["adx_value"], loops.adx(*(pdf[c].to_numpy() for c in ("high", "low", "close"))))
    assert not got["should_trade"][(got["ts"].dt.hour >= 17) & (got["ts"].dt.hour < 22)].any()


def test_trades_over_blocks(spark):
    pdf = walk(6000)
    rng = np.random.default_rng(9)
    pdf["direction"] = rng.choice(["long", "short", "neutral"], 6000, p=[0.1, 0.1, 0.8])
    pdf.loc[pdf.index[-1], "direction"] = "long"
    rows = frame(spark, pdf).join(spark.createDataFrame(pdf[["ts", "direction"]], "ts timestamp, direction string"), "ts")
    found, checked = tr.replay(rows, 12, spread=0.3)
    got = found.toPandas().sort_values("signal_ts").reset_index(drop=True)
    chosen = loops.chosen_trades(pdf["direction"] != "neutral", 12)
    assert got["signal_ts"].tolist() == pdf["ts"].iloc[chosen].tolist()
    for i, t in zip(chosen, got.itertuples()):
        out = min(i + 12, 5999)
        entry, leave = pdf["open"][i + 1], pdf["close"][out]
        side = 1 if t.direction == "long" else -1
        assert (t.entry_ts, t.exit_ts, t.bars_held) == (pdf["ts"][i + 1], pdf["ts"][out], out - i)
        assert t.pnl_pct == pytest.approx((side * (leave - entry) - 0.3) / entry * 100)
    busy = sum(min(12, 5999 - i) for i in chosen) - len(chosen)  # bars at which a position stays open
    assert checked.count() == 6000 - busy - sum(1 for i in chosen if i + 12 > 5999)
    grid = tr.replay_grid(rows, [6, 12], [0.0, 0.3])
    assert grid.filter("horizon = 12 AND spread = 0.3").agg(F.sum("pnl_pct")).first()[0] == pytest.approx(got["pnl_pct"].sum())


def trades_frame(spark, pnl, held=10, regime="ranging"):
    rows = [("X", "5m", "long" if i % 2 else "short", datetime(2024, 1, 1) + timedelta(hours=i), held, p, regime) for i, p in enumerate(pnl)]
    return spark.createDataFrame(rows, "symbol string, timeframe string, direction string, exit_ts timestamp, bars_held int, pnl_pct double, regime_state string")


def gated_loop(pdf: pd.DataFrame, horizon: int) -> tuple[list, list]:
    """Bar by bar: the regime is asked, and moves on, only while flat."""
    zone = state = "ranging"
    run = left = 0
    trades, checked = [], []
    for i, r in enumerate(pdf.itertuples()):
        left = max(left - 1, 0)
        if left > 0 or not r.ok:
            continue
        zone = r.explicit_state or zone
        conf, proposed = r.intraday_conf, zone
        if r.hmm_state is not None and r.hmm_prob == r.hmm_prob:
            scores = {s: 0.6 * conf * (s == zone) + 0.3 * r.hmm_prob * (s == r.hmm_state) + 0.1 * (r.recent_change and s == rg.HIGH) for s in rg.STATES}
            proposed = max(rg.STATES, key=lambda s: scores[s])
            conf = scores[proposed] / sum(scores.values())
        elif r.recent_change:
            conf *= 0.9
        run = run + 1 if proposed != state else 0
        if run >= 3:
            state, run = proposed, 0
        if conf < 0.6 or 17 <= r.ts.hour < 22:
            continue
        checked.append((r.ts, state))
        if r.direction in ("long", "short") and i + 1 < len(pdf) and pdf["open"].iloc[i + 1] > 0:
            trades.append((r.ts, r.direction, pdf["open"].iloc[i + 1], pdf["close"].iloc[min(i + horizon, len(pdf) - 1)], state))
            left = horizon
    return trades, checked


@pytest.mark.parametrize("horizon", [1, 7])
def test_regime_that_waits_while_a_position_is_open(spark, horizon):
    rng = np.random.default_rng(horizon)
    parts = []
    for symbol, n in (("A", 1300), ("B", 310)):
        pdf = walk(n, symbol, "1h", minutes=60, seed=n)
        pdf["direction"] = rng.choice(["long", "short", "neutral", None], n, p=[0.2, 0.2, 0.5, 0.1])
        pdf["explicit_state"] = rng.choice([*rg.STATES, None], n, p=[0.1, 0.1, 0.1, 0.7])
        pdf["hmm_state"] = rng.choice([*rg.STATES, None], n, p=[0.2, 0.2, 0.2, 0.4])
        pdf["intraday_conf"], pdf["hmm_prob"] = rng.choice([0.5, 0.7, 0.95], n), rng.choice([0.4, 0.9, np.nan], n)
        pdf["recent_change"], pdf["ok"] = rng.random(n) < 0.2, (rng.random(n) < 0.9) & (np.arange(n) > 40)
        pdf.loc[7::90, "open"] = 0.0
        parts.append(pdf)
    rows = spark.createDataFrame(pd.concat(parts)).withColumn("hmm_prob", F.nanvl("hmm_prob", F.lit(None)))
    trades, checked = gated.replay_while_flat(rows, horizon, eligible=F.col("ok"), block_rows=300)
    for pdf in parts:
        want, asked = gated_loop(pdf, horizon)
        mine = trades.filter(F.col("symbol") == pdf["symbol"].iloc[0]).orderBy("signal_ts").collect()
        assert [(r["signal_ts"], r["direction"], r["entry_price"], r["exit_price"], r["regime_state"]) for r in mine] == want
        seen = checked.filter(F.col("symbol") == pdf["symbol"].iloc[0]).orderBy("ts").collect()
        assert [(r["ts"], r["regime_state"]) for r in seen] == asked
    assert gated.replay_while_flat(rows.limit(0), horizon)[0].count() == 0


def test_backtest_with_votes(spark):
    """The job takes votes in place of decisions; both at once are refused."""
    bars = frame(spark, walk(300, "XAUUSD", "1h", minutes=60))
    signal = bars.select(*SERIES, "ts", F.lit("long").alias("direction"), F.lit(True).alias("warmup_complete"))
    features = bars.select(*SERIES, "ts", F.lit(2.0).alias("atr_14"))
    votes = regime_votes(bars, features)
    trades, report = backtest(bars, signal, "1h", votes=votes)
    row = report.first()
    assert trades.count() == row["trade_count"] > 0 and row["signals_generated"] >= row["trade_count"]
    with pytest.raises(ValueError):
        backtest(bars, signal, "1h", votes=votes, regimes=votes)


def test_trade_metrics_by_hand(spark):
    pnl = np.array([1.0, -0.5, 2.0, 0.0, -1.0])
    got = pf.trade_metrics(trades_frame(spark, pnl.tolist())).first()
    scale = np.sqrt(252 * 6.5 / 10)
    curve = np.cumprod(1 + pnl / 100)
    assert got.total_return == pytest.approx((curve[-1] - 1) * 100)
    assert got.sharpe_ratio == pytest.approx(pnl.mean() / pnl.std(ddof=1) * scale)
    assert got.sortino_ratio == pytest.approx(pnl.mean() / pnl[pnl < 0].std(ddof=1) * scale)
    assert got.profit_factor == pytest.approx(2.0) and got.win_rate == 40 and got.avg_loss == pytest.approx(-0.5)
    assert got.max_drawdown == pytest.approx(100 * np.max(1 - curve / np.maximum.accumulate(curve)))
    rounded = pf.rounded_metrics(pf.trade_metrics(trades_frame(spark, pnl.tolist()))).first()
    assert (rounded.total_return, rounded.profit_factor) == (round(got.total_return, 2), 2.0)


@pytest.mark.parametrize("pnl, factor, sortino", [([1.0, 2.0], 99.99, None), ([0.0, 0.0], 99.99, 0.0), ([1.0], 99.99, 0.0),
                                                 ([-1.0], 0.0, 0.0), ([1.0, -1.0], 1.0, 0.0), ([None, None], 0.0, 0.0)])
def test_trade_metrics_edges(spark, pnl, factor, sortino):
    got = pf.trade_metrics(trades_frame(spark, pnl)).first()
    assert got.trade_count == len(pnl) and got.profit_factor == pytest.approx(factor)
    assert got.sortino_ratio == pytest.approx(2 * got.sharpe_ratio if sortino is None else sortino)


def test_breakdowns(spark):
    rows = trades_frame(spark, [1.0, -2.0, 3.0]).unionByName(trades_frame(spark, [5.0], regime=None))
    by = pf.regime_breakdown(rows).collect()
    assert len(by) == 1 and by[0].trade_count == 3 and by[0].total_return == pytest.approx((1.01 * 0.98 * 1.03 - 1) * 100)
    sides = {r.direction: r for r in pf.direction_breakdown(rows).collect()}
    assert sides["long"].profit_factor == 0.0 and sides["short"].profit_factor == pytest.approx(99.99)


@pytest.mark.parametrize("compound", [True, False])
def test_curves_over_slices(spark, compound):
    rng = np.random.default_rng(2)
    pdf = walk(9000)
    pdf["r"] = rng.normal(0, 0.01, 9000)
    if compound:
        pdf.loc[[4000, 8000], "r"] = -1.5
    rows = spark.createDataFrame(pdf[["symbol", "timeframe", "ts", "r"]], "symbol string, timeframe string, ts timestamp, r double")
    got = collect(pf.running_curve(rows, "r", SERIES, "ts", 300, compound), "equity", "peak", "drawdown")
    equity = np.cumprod(1 + pdf["r"]) if compound else np.cumsum(pdf["r"])
    peak = np.maximum.accumulate(equity)
    same(got["equity"], equity)
    same(got["peak"], peak)
    same(got["drawdown"], (peak - equity) / peak if compound else peak - equity)


def test_fold_metrics_edges(spark):
    one = spark.createDataFrame([("X", "5m", datetime(2024, 1, 1), 1.0, 1.0, 0.01)], "symbol string, timeframe string, ts timestamp, prediction double, label double, forward_return double")
    got = pf.fold_metrics(one, SERIES, 300).first()
    assert got.std_return == 1.0 and got.sharpe_ratio == pytest.approx(0.01 * np.sqrt(252 * 78)) and got.profit_factor == pytest.approx(0.01)
    assert got.max_drawdown == 0 and got.accuracy == 1
    good = spark.createDataFrame([(1.0, 1.5, 1.3, 0.4, 0.2, 100)], "sharpe_ratio double, sortino_ratio double, profit_factor double, win_rate double, max_drawdown double, trade_count int")
    assert good.select(pf.meets(), pf.meets(pf.TARGET)).first()[:] == (True, False)


def test_backtest_job(spark):
    pdf = walk(500)
    signal = frame(spark, pdf).select(*SERIES, "ts").withColumns({
        "direction": F.when(F.minute("ts") == 0, "long").otherwise("neutral"), "warmup_complete": F.col("ts") >= F.lit(pdf["ts"][48])})
    regimes = frame(spark, pdf).select(*SERIES, "ts").withColumns({"state": F.lit("ranging"), "should_trade": F.hour("ts") < 17})
    trades, report = backtest(frame(spark, pdf), signal, "5m", 0.3, regimes)
    row, found = report.first(), trades.toPandas()
    assert row.trade_count == len(found) > 20 and row.bars_processed == 500
    assert (found["signal_ts"].dt.hour < 17).all() and (found["signal_ts"] >= pdf["ts"][48]).all() and set(found["regime_state"]) == {"ranging"}


def test_holding_periods(spark):
    got = spark.range(1, 26).select(holding_period("id").alias("h")).select("h", holding_period_bars("h").alias("n")).toPandas()
    assert got["h"].tolist() == ["15m"] * 3 + ["30m"] * 3 + ["1h"] * 6 + ["2h"] * 13 and got["n"].tolist() == [3] * 3 + [6] * 3 + [12] * 6 + [24] * 13
