from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import collect, frame, same, walk
from pyspark.sql import functions as F

from tidebars.functions.records import to_record
from tidebars.operators import regime as rg
from tidebars.operators.features import compute_features
from tidebars.operators.labels import attach_returns, flat_dataset
from tidebars.operators.models import Ensemble, EnsembleConfig, evaluate_fold, fit_ensemble, run_summary, train_run
from tidebars.operators.resample import resample
from tidebars.operators.trades import signal_rule
from tidebars.operators.trees import TreeTable
from tidebars.plans import catalog
from tidebars.plans.pipelines import build_features, ingest, summary, training_overlaps
from tidebars.schema import BARS, FEATURE_COLUMNS, SERIES
from tidebars.streaming.features import NUMBERS, features_stream, proxy_bars, regime_stream
from tidebars.streaming.publish import append_to, as_records, fan_out, upsert_latest
from tidebars.streaming.replay import drain, drain_batches, stream_parquet, stream_records
from tidebars.streaming.resample import flush, live_to_minutes, resample_stream, resample_stream_early
from tidebars.streaming.signals import decisions, signal_handler


def feed(spark, path, *parts):
    """One file per part, in order, streamed one at a time."""
    for pdf in parts:
        frame(spark, pdf).coalesce(1).write.mode("append").parquet(str(path))
    return stream_parquet(spark, str(path), BARS, files_per_batch=1)


def test_watermark_resampling_and_flush(spark, tmp_path):
    pdf = walk(100).drop(index=[4, 50])
    bars = feed(spark, tmp_path / "in", pdf.iloc[:40], pdf.iloc[40:])
    out = drain(resample_stream(bars, "5m", "15m"), str(tmp_path / "out"))
    rest = flush(frame(spark, pdf), out, "5m", "15m")
    batch = resample(frame(spark, pdf), "5m", "15m")
    assert 0 < rest.count() < 5 and out.unionByName(rest).exceptAll(batch).count() == 0
    assert out.count() + rest.count() == batch.count()


def test_early_resampling(spark, tmp_path):
    pdf = walk(20).drop(index=[4])
    late = pdf.iloc[[1]]
    bars = feed(spark, tmp_path / "in", pdf.iloc[:10], pdf.iloc[10:], late)
    out = collect(drain(resample_stream_early(bars, "5m", "15m"), str(tmp_path / "out")), "volume", "is_complete")
    # periods 0-5 are out (the second one partial), the last one (two bars) was cut off by the late bar
    assert out["is_complete"].tolist() == [True, False, True, True, True, True, False]
    assert out["volume"].tolist() == [pdf[pdf.index // 3 == i]["volume"].sum() for i in range(7)]


def test_live_bars(spark, tmp_path):
    rows = [("XAUUSD", datetime(2024, 1, 2, 0, 5 * i // 60, 5 * i % 60), str(2000 + i), str(2001 + i), str(1999 + i), str(2000.5 + i), "1") for i in range(30)]
    schema = "symbol string, ts timestamp, open string, high string, low string, close string, volume string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = drain(live_to_minutes(live), str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.is_complete) for r in got] == [
        (2000.0, 2012.0, 1999.0, 2011.5, 12.0, True), (2012.0, 2024.0, 2011.0, 2023.5, 12.0, True)]


def test_stream_features_equal_batch(spark, tmp_path):
    pdf, other = walk(150), walk(90, "EURUSD", seed=5)
    pdf.loc[70, "close"] = 0.0
    bars = feed(spark, tmp_path / "in", pd.concat([pdf.iloc[:60], other.iloc[:20]]), pdf.iloc[60:61], pd.concat([pdf.iloc[61:], other.iloc[20:]]),
                pdf.iloc[:5])
    columns = [*NUMBERS, "is_asian_session", "day_of_week", "warmup_complete"]
    got = collect(drain(features_stream(bars), str(tmp_path / "out")), *columns)
    want = collect(compute_features(frame(spark, pd.concat([pdf, other]))), *columns)
    same(got[columns].astype(float), want[columns].astype(float), 1e-9)


def test_stream_regime_equals_batch(spark, tmp_path):
    pdf = walk(260)
    rng = np.random.default_rng(3)
    pdf["close"] += np.where(np.arange(260) > 150, rng.normal(0, 20, 260), 0)
    pdf["high"], pdf["low"] = pdf[["high", "close"]].max(axis=1), pdf[["low", "close"]].min(axis=1)

    def with_atr(df):
        return df.withColumns({"atr_14": F.col("volume") / 300, "hmm_state": F.when(F.hour("ts") > 5, "ranging"),
                               "hmm_prob": F.when(F.hour("ts") > 5, 0.7)})

    bars = with_atr(feed(spark, tmp_path / "in", pdf.iloc[:100], pdf.iloc[100:]))
    columns = ["state", "confidence", "position_multiplier", "should_trade", "adx_value", "recent_change", "reason"]
    got = collect(drain(regime_stream(bars), str(tmp_path / "out")), *columns)
    day = with_atr(frame(spark, pdf)).drop("hmm_state", "hmm_prob")
    base = rg.intraday_regime(rg.adx(day))
    voted = with_atr(rg.with_change_points(base))
    state, conf = rg.combine_votes(*[F.col(c) for c in ("intraday_state", "intraday_conf", "hmm_state", "hmm_prob", "recent_change")])
    want = rg.decide(rg.persist(voted.withColumns({"proposed_state": state, "vote_conf": conf})))
    want = collect(want.withColumn("adx_value", F.col("adx_14")), *columns)
    for c in ("adx_value", "confidence", "position_multiplier"):
        same(got[c], want[c])
    for c in ("state", "should_trade", "recent_change", "reason"):
        assert got[c].tolist() == want[c].tolist()
    assert got["recent_change"].any() and got["state"].nunique() > 1


def test_topics_and_latest(spark, tmp_path):
    pdf, other = walk(50), walk(30, "EURUSD")
    records = as_records(feed(spark, tmp_path / "in", pdf.iloc[:20], pd.concat([pdf.iloc[20:], other])), "bar")

    def broken(rows, number):
        raise RuntimeError("no")

    handler = fan_out({"bar.xauusd": [broken, append_to(str(tmp_path / "gold"))], "bar.": [append_to(str(tmp_path / "all"))]})
    drain_batches(records, handler, str(tmp_path / "progress"))
    assert spark.read.json(str(tmp_path / "gold")).count() == 50 and spark.read.json(str(tmp_path / "all")).count() == 80
    spark.read.json(str(tmp_path / "all")).select("value").write.text(str(tmp_path / "wire"))
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(str(tmp_path / "wire"))
    back = drain(stream_records(spark, str(tmp_path / "wire"), "bar"), str(tmp_path / "back"))
    assert back.count() == 80
    drain_batches(stream_parquet(spark, str(tmp_path / "in"), BARS, 1), upsert_latest(str(tmp_path / "latest")), str(tmp_path / "p2"))
    got = collect(spark.read.parquet(str(tmp_path / "latest")), "close")
    assert got["close"].tolist() == [other["close"].iloc[-1], pdf["close"].iloc[-1]]


def test_signal_job(spark, tmp_path):
    features = compute_features(frame(spark, walk(150)))
    features.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_parquet(spark, str(tmp_path / "in"), features.schema)

    def score(rows):
        return rows.withColumns({"direction": F.when(F.minute("ts") < 30, "long").otherwise("neutral"), "confidence": F.lit(0.7), "predicted_horizon": F.lit("2h")})

    drain_batches(decisions(stream), signal_handler(score, append_to(str(tmp_path / "out"))), str(tmp_path / "progress"))
    out = spark.read.json(str(tmp_path / "out"))
    topics = {r.topic: r["count"] for r in out.groupBy("topic").count().collect()}
    assert topics["regime.xauusd"] == 102 and 0 < topics["signal.xauusd"] < 102
    proxied = proxy_bars(features.filter("warmup_complete")).select("close", "bb_middle").first()
    assert proxied.close == proxied.bb_middle

    def fails(rows):
        raise RuntimeError("no model")

    drain_batches(decisions(stream), signal_handler(fails, append_to(str(tmp_path / "out2"))), str(tmp_path / "progress2"))
    assert spark.read.json(str(tmp_path / "out2")).count() == 102


@pytest.fixture(scope="module")
def dataset(spark):
    pdf = walk(700)
    pdf["close"] = 2000 + 30 * np.sin(np.arange(700) / 9) + pdf["close"] / 500
    pdf["high"], pdf["low"] = pdf["close"] + 1, pdf["close"] - 1
    bars = frame(spark, pdf)
    features = compute_features(bars).na.fill(0.0, [c for c in FEATURE_COLUMNS if c.startswith(("dxy", "vix"))])
    data = flat_dataset(features, bars, 6)
    return attach_returns(data.drop("close", "high", "low"), bars, 6).cache()


LIGHT = EnsembleConfig(horizon=6).light(lookback=8)


def test_ensemble(spark, dataset, tmp_path):
    model = fit_ensemble(dataset, LIGHT)
    scored = model.score(dataset)
    assert scored.count() == dataset.count() - 7
    got = model.signals(scored).toPandas()
    assert np.allclose(got["prob_long"] + got["prob_short"], 1)
    hit = got[got.direction != "neutral"]
    assert ((hit.direction == "long") == (hit.label == 1)).mean() > 0.7
    assert (hit.confidence > 0.55).all() and (got[got.direction == "neutral"].confidence == 0).all()
    whole = model.score(dataset, keep_short=True)
    assert whole.count() == dataset.count() and whole.filter("sequence_long = 0.5").count() >= 7
    model.save(str(tmp_path / "model"))
    again = collect(Ensemble.load(str(tmp_path / "model")).score(dataset), "prob_long")
    same(again["prob_long"], collect(scored, "prob_long")["prob_long"])
    top = model.attributions(dataset.limit(20)).collect()
    assert len(top) == 20 and all(len(r.top_features) == 5 for r in top)
    short = evaluate_fold(model, dataset.orderBy("ts").limit(5))
    assert short.count() == 5


def test_training_run(spark, dataset):
    model, results = train_run(dataset, LIGHT, folds=2)
    rows = results.orderBy("fold").collect()
    n = dataset.count()
    assert [r.train_size for r in rows] == [n // 3, 2 * (n // 3)] and rows[0].trade_count == rows[0].test_size - 7
    assert run_summary(results).first().folds == 2 and model.meta is not None
    with pytest.raises(ValueError, match="200"):
        train_run(dataset.limit(100), LIGHT)


def test_signal_rule(spark):
    rows = spark.createDataFrame([(0.55, 0.45), (0.56, 0.44), (0.3, 0.7)], "l double, s double")
    direction, confidence = signal_rule(F.col("l"), F.col("s"))
    got = rows.select(direction.alias("d"), confidence.alias("c")).collect()
    assert [(r.d, r.c) for r in got] == [("neutral", 0.0), ("long", 0.56), ("short", 0.7)]


def test_batch_jobs(spark, tmp_path):
    pdf = walk(300)
    raw = spark.createDataFrame(pdf.assign(volume=pdf["volume"].astype(str), **{c: pdf[c].astype(str) for c in ("open", "high", "low", "close")})[
        ["ts", "open", "high", "low", "close", "volume"]], "ts timestamp, open string, high string, low string, close string, volume string").withColumns({
            "symbol": F.lit(None).cast("string"), "timeframe": F.lit(None).cast("string")})
    bars_path, features_path = str(tmp_path / "bars"), str(tmp_path / "features")
    bars = ingest(raw, bars_path, str(tmp_path / "rejects"))
    assert bars.filter("timeframe = '5m'").count() == 300 and bars.filter("timeframe = '1h'").count() == 25
    build_features(spark, bars_path, features_path)
    got = {r.timeframe: (r.bars, r.features, r.warm) for r in summary(spark, bars_path, features_path).collect()}
    assert got == {"5m": (300, 300, 252), "15m": (100, 100, 52), "1h": (25, 25, 0), "4h": (7, 7, 0)}
    runs = spark.createDataFrame([("2024-01-01", "2024-02-01"), ("2023-01-01", "2023-02-01")], "start string, end string")
    assert training_overlaps(runs, F.lit(datetime(2024, 1, 15)), F.lit(datetime(2024, 3, 1))).count() == 1


def test_catalog_is_complete():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 80


def test_trees_as_a_table(spark):
    """Scores of the node table are the model's; effects are those of scoring each variant."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (400, 5)), 1)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(400) < 0.1)).astype(float)
    data = spark.createDataFrame([(i, v.tolist(), float(label)) for i, (v, label) in enumerate(zip(x, y))], "k long, x array<double>, label double")
    data = data.withColumn("features", array_to_vector("x")).repartition(3)
    model = GBTClassifier(maxIter=6, maxDepth=4, stepSize=0.2, seed=3).fit(data)
    table = TreeTable.of_model(model)
    want = dict(model.transform(data).select("k", vector_to_array("probability")[1]).collect())
    got = dict(table.scores(data, ["k"], "x").collect())
    np.testing.assert_allclose([got[k] for k in range(400)], [want[k] for k in range(400)], atol=1e-12)
    means = x.mean(axis=0)
    effects = table.effects(x, means)
    for i in range(5):
        changed = x.copy()
        changed[:, i] = means[i]
        again = [1 / (1 + np.exp(-2 * m)) for m in table.values(changed).sum(axis=1)]
        np.testing.assert_allclose(effects[:, i], [want[k] - again[k] for k in range(400)], atol=1e-12)
    top = {r["k"]: r["top_features"] for r in table.attributions(data, ["k"], "x", list("abcde"), means, 2).collect()}
    for k in range(400):
        order = sorted(range(5), key=lambda i: (-round(abs(effects[k, i]), 12), i))[:2]
        assert top[k] == pytest.approx({"abcde"[i]: effects[k, i] for i in order})
    plan = table.attributions(data, ["k"], "x", list("abcde"), means)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == data._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert table.scores(data.limit(0), ["k"], "x").count() == 0


def test_stream_bars_give_every_hour_of_events_over_several_months(spark, tmp_path):
    from tidebars.plans.stream_queries import stream_bars
    from tidebars.sources.driver_tables import event_bars

    times = pd.date_range("2024-01-28 10:07", "2024-03-05 09:59", freq="97min")
    events = pd.DataFrame({"event_type": ["click", "view"] * (len(times) // 2), "ts": times[:len(times) // 2 * 2]})
    events["value"] = np.arange(len(events)) % 13 * 1.5
    spark.createDataFrame(events).write.parquet(str(tmp_path / "events.parquet"))
    numbers = ["open", "high", "low", "close", "volume"]
    got, wanted = (collect(f(spark, str(tmp_path)), *numbers) for f in (stream_bars, event_bars))
    assert list(got.ts) == list(wanted.ts) and list(got.symbol) == list(wanted.symbol)
    same(got[numbers], wanted[numbers])
