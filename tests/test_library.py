"""Kernels, recurrences, sources, sinks and streams."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import alerts, asof, correlation, ewm, fill, kernels, outliers, predictions, robust, text
from tidewater.sinks import upsert
from tidewater.sources import files
from tidewater.sources.polling import MarketHistory
from tidewater.sources.tables import by_time
from tidewater.streaming import parse, pipeline, stateful

START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def series(spark, rows):
    return spark.createDataFrame([(k, at(h), v) for k, h, v in rows], "k string, t timestamp, x double")


def test_ewm_equals_pandas_with_gaps_and_many_keys(spark):
    rng = random.Random(1)
    rows = [(k, h, None if rng.random() < 0.2 else rng.random()) for k in "abc" for h in range(200)] + [(None, 0, 1.0)]
    for adjust in (True, False):
        got = ewm.ewm(series(spark, rows), "x", "e", span=10, adjust=adjust).toPandas()
        for k in "abc":
            own = got[got["k"] == k].sort_values("t")
            want = pd.Series([v for kk, _, v in rows if kk == k], dtype=float).ewm(span=10, adjust=adjust, ignore_na=True).mean()
            np.testing.assert_allclose(own["e"].to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_cooldown_counts_from_the_last_emitted_alert(spark):
    got = ewm.cooldown(series(spark, [("a", h, 0.0) for h in (0, 2, 4, 6, 7, 12, 13)] + [("b", 1, 0.0)]), 6 * 3600)
    assert sorted((r["k"], r["t"].hour) for r in got.where("emitted").collect()) == [("a", 0), ("a", 6), ("a", 12), ("b", 1)]


def test_interval_join_broadcasts_no_copies_of_intervals(spark):
    spans = spark.createDataFrame([("a", at(0), at(30)), ("a", at(20), at(500)), ("b", at(5), at(6)), (None, at(0), at(9)), ("b", at(9), None)], "k string, s timestamp, e timestamp")
    points = series(spark, [("a", h, float(h)) for h in (0, 24, 30, 499, 500)] + [("b", 5, 5.0), ("b", 6, 6.0), ("b", 9, 9.0), (None, 1, 1.0)])
    got = asof.interval_join(points, spans, ["k"], "t", "s", "e", 3600)
    assert sorted((r["k"], r["x"], (r["s"] - START).total_seconds() / 3600) for r in got.collect()) == [("a", 0, 0), ("a", 24, 0), ("a", 24, 20), ("a", 30, 20), ("a", 499, 20), ("b", 5, 5)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_interpolation_and_edges(spark):
    df = series(spark, [("a", 0, None), ("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 4.0), ("a", 5, None), ("b", 0, None)])
    got = {(r["k"], r["t"].hour): r["x"] for r in fill.interpolate(df, "x", by_time()).collect()}
    assert [got["a", h] for h in range(6)] == [1, 1, 2, 3, 4, 4] and got["b", 0] is None


def test_kernels():
    t = np.arange(480)
    rank, period, share = kernels.fft_cycles(np.sin(2 * np.pi * t / 24))[0]
    assert (rank, round(period)) == (1, 24) and share > 0.99
    x = np.polyval([0.01, -0.2, 1, 3], np.linspace(-3, 3, 60))
    np.testing.assert_allclose(kernels.savitzky_golay(x), x, atol=1e-9)
    rng = np.random.default_rng(0)
    calm, wild = rng.normal(0, 0.1, 200), rng.normal(0, 3, 200)
    states = np.array([s for _, s, _ in kernels.hidden_markov(np.concatenate([calm, wild]), 2)])
    assert (states[:200] == 0).mean() > 0.95 and (states[200:] == 1).mean() > 0.9
    scores = kernels.isolation_scores(np.append(rng.normal(0, 1, 200), 40.0))
    assert max(scores, key=lambda r: r[1])[0] == 200
    assert [i for i, _ in kernels.spaced_peaks(np.array([0, 5, 0, 4, 0, 0, 3, 0.0]), 3)] == [1, 6]
    assert abs(kernels.hurst(rng.normal(0, 1, 4000)) - 0.55) < 0.15
    assert kernels.lempel_ziv(np.tile([0, 1], 200)) < kernels.lempel_ziv(rng.normal(0, 1, 400))
    np.testing.assert_allclose(kernels.hodrick_prescott(t[:50] * 2.0), t[:50] * 2.0, atol=1e-6)
    for f in (kernels.fft_cycles, kernels.entropy_suite, kernels.denoised, kernels.hidden_markov, kernels.isolation_scores, kernels.spaced_peaks):
        f(np.empty(0)), f(np.ones(3)), f(np.ones(40))


@pytest.mark.parametrize("n", [5, 700, 1500])
def test_sample_entropy_takes_the_whole_series(n):
    rng = np.random.default_rng(n)
    x = np.append(np.sin(np.arange(n // 2)), rng.normal(0, 1, n - n // 2))

    def matches(width):
        v = np.stack([x[i : i + width] for i in range(n - 2)])
        return sum(int((np.abs(v - row).max(1) <= 0.2 * x.std()).sum()) - 1 for row in v)

    a, b = matches(3), matches(2)
    assert kernels.sample_entropy(x) == (float(-np.log(a / b)) if a and b else None)


def test_kernels_take_whole_series(spark):
    n = 5_000
    x = np.sin(2 * np.pi * np.arange(n) / 2_500) + 0.01 * np.random.default_rng(1).normal(0, 1, n)
    x[4095:4097] = 9.0, 8.0  # a peak where windows of 4096 rows met
    x[4099] = 8.5  # nearer to it than 12 rows
    df = series(spark, [("a", h, float(v)) for h, v in enumerate(x)])
    run = lambda kernel, schema: kernels.per_key(df, "k", "t", "x", kernel, schema).collect()
    period = next(r for r in run(kernels.fft_cycles, "rank int, period double, share double") if r["rank"] == 1)
    assert (period["chunk"], round(period["period"])) == (0, 2_500)
    at = sorted(r["i"] for r in run(kernels.spaced_peaks, "i long, value double"))
    assert 4095 in at and 4099 not in at and np.diff(at).min() >= 12
    flags = run(kernels.isolation_scores, "i long, score double, outlier boolean")
    assert sorted(r["i"] for r in flags) == list(range(n)) and {r["chunk"] for r in flags} == {0}
    states = run(kernels.hidden_markov, "i long, state int, p double")
    assert sorted(r["i"] for r in states) == list(range(n))


@pytest.mark.parametrize("n", [3, 4, 5, 60, 1500])
def test_trend_solves_its_equations_at_any_length(n):
    x = np.random.default_rng(n).normal(0, 1, n).cumsum()
    d = np.diff(np.eye(n), 2, axis=0)
    want = np.linalg.solve(np.eye(n) + 1600 * d.T @ d, x)
    np.testing.assert_allclose(kernels.hodrick_prescott(x), want, atol=1e-6)
    np.testing.assert_allclose([r[3] for r in kernels.denoised(x)], want, atol=1e-6)


def test_kernels_see_bounded_windows(spark):
    got = kernels.per_key(series(spark, [("a", h, float(h)) for h in range(25)]), "k", "t", "x", lambda v: [(len(v), float(v[0]))], "n long, first double", chunk=10).collect()
    assert sorted((r["chunk"], r["n"], r["first"]) for r in got) == [(0, 10, 0.0), (1, 10, 10.0), (2, 5, 20.0)]


def test_column_pruning(spark):
    rng = random.Random(2)
    rows = [(a := rng.random(), a * 2, rng.random(), 1.0, None) for _ in range(200)]
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "a double, b double, c double, flat double, hole double, copy double")
    assert correlation.useful_columns(df, df.columns) == ["a", "b", "c"]
    assert correlation.drop_correlated(df, ["a", "b", "c"]) == ["a", "c"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "id long, v string")
    as_map = lambda df: {r["id"]: r["v"] for r in df.collect()}
    assert as_map(upsert.upsert(old, new, ["id"])) == {1: "old", 2: "new", 3: "new"}
    assert as_map(upsert.upsert(old, new, ["id"], keep="old")) == {1: "old", 2: "old", 3: "new"}


def test_alert_grammar_and_gates(spark):
    df = spark.createDataFrame([('/set_alert rsi_14 >= 70.5 "hot"',), ("/set_alert x < -3",), ("hello",), (None,)], "s string")
    got = df.select(*[v.alias(n) for n, v in alerts.parse_command("s").items()]).collect()
    assert [tuple(r) for r in got] == [("rsi_14", ">=", 70.5, "hot"), ("x", "<", -3.0, None), (None,) * 4, (None,) * 4]
    watch = spark.createDataFrame([("비트코인 9만 넘으면 알려줘",), ("RSI 30 이하",)], "s string").select(*[v.alias(n) for n, v in alerts.parse_watch("s").items()]).collect()
    assert [tuple(r) for r in watch] == [("비트코인", 90_000.0, ">"), ("RSI", 30.0, "<=")]


def test_quality_and_folds(spark):
    assert predictions.folds(100, 50, 20, gap=5) == [(0, 1, 50, 56, 75), (1, 21, 70, 76, 95)]
    assert predictions.folds(100, 50, 20, expanding=True)[1][1] == 1
    score = outliers.quality_score(series(spark, [("a", h, float(h % 7)) for h in range(48)]), "x", by_time()).collect()[0]
    assert score["completeness"] == 1 and 0 < score["score"] <= 1


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2.5, "d": "x"}, "e": null}'), (2, None)], "id long, j string")
    assert sorted((r["id"], r["path"], r["value"]) for r in text.flatten_numbers(df, "j", ["id"]).collect()) == [(1, "a", 1.0), (1, "b.c", 2.5)]


def test_file_sources(spark, tmp_path):
    folder = tmp_path / "market"
    folder.mkdir()
    (folder / "price_hourly.csv").write_text("ts,value\n2024-01-01 00:00:00,1.5\n")
    (folder / "price_daily.csv").write_text("ts,value\n2024-01-01 00:00:00,9\n")
    got = files.indicator_files(spark, str(tmp_path)).collect()
    assert [(r["value"], r["category"], r["indicator"]) for r in got] == [(1.5, "market", "price")]
    for other in ("macro", "on chain"):
        (tmp_path / other).mkdir()
        (tmp_path / other / "rate_hourly.csv").write_text("ts,value\n2024-01-01 00:00:00,2.5\n")
    one = files.indicator_files(spark, str(tmp_path)).where("category = 'on chain'")
    assert [(r["value"], r["category"], r["indicator"]) for r in one.collect()] == [(2.5, "on chain", "rate")]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(category" in plan
    for day in (1, 2, 3):
        (folder / f"btc_analysis_2024-01-0{day}_12-00-00.json").write_text('{"x": %d}' % day)
    snaps = tmp_path / "snaps"
    snaps.mkdir()
    for day in (1, 2, 3):
        (snaps / f"btc_analysis_2024010{day}_120000.json").write_text('{"x": %d}' % day)
    assert sorted(r["document"] for r in files.json_snapshots(spark, str(snaps), last=2).collect()) == ['{"x": 2}', '{"x": 3}']
    frame = spark.createDataFrame([(1, 20_000.0, "x")], "Date int, odd double, s string")
    assert (files.time_column(frame), files.price_column(frame), files.numeric_columns(frame)) == ("Date", "odd", ["Date", "odd"])


def quotes(symbol, since):
    return [(START, 10.0, 1.0), (at(1), 11.0, 2.0)]


def test_python_data_source(spark):
    spark.dataSource.register(MarketHistory)
    got = spark.read.format("market_history").option("symbols", "A,B").option("client", "tests.test_library:quotes").load()
    assert got.rdd.getNumPartitions() == 2 and got.count() == 4


RAW = [
    ("b", "binance_ticker", '{"s":"BTC","E":1704067200000,"c":"42000","v":"3","b":"41999","a":"42001"}'), ("b", "binance_trades", '{"s":"BTC","T":1704067201000,"p":"42010","q":"0.5"}'),
    ("b", "binance_depth", '{"s":"BTC","E":1704067202000,"b":[["41990","1"]],"a":[["42010","2"]]}'), ("c", "coinbase_ticker", '{"product_id":"BTC-USD","time":"2024-01-01T00:00:03Z","price":"42005","volume_24h":"9"}'),
    ("g", "generic", '{"symbol":"BTC","ts":1704067204000,"price":5,"volume":1}'), ("g", "generic", "broken"), ("g", "nobody", "{}"),
]


def test_parsers(spark):
    raw = spark.createDataFrame([(*r, at(0) + dt.timedelta(seconds=10)) for r in RAW], "source string, parser string, payload string, ingest_ts timestamp")
    got = parse.parse(raw).withColumn("errors", parse.errors()).collect()
    assert [r["price"] for r in got] == [42000, 42010, 42000, 42005, 5, None, None]
    assert [len(r["errors"]) == 0 for r in got] == [True, True, True, True, False, False, False]
    assert got[0]["latency_ms"] == 10_000 and got[2]["bid"] == 41990


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    stream = pipeline.file_stream(spark, folder, names="events.parquet").withColumnRenamed("event_type", "symbol").withColumnRenamed("value", "price")
    bars = pipeline.windowed_bars(stream, "1 hour", late="40 days")
    drained(pipeline.run(bars, f"{tmp_path}/c", sink=lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}"), mode="complete"))
    last = max((int(p.name) for p in (tmp_path / "out").iterdir()))
    got = {(r["k"], r["t"]): (r["open"], r["high"], r["low"], r["close"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out/{last}").collect()}
    batch = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg(F.min_by("value", "ts").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "ts").alias("c"), F.count("*").alias("n"))
    assert got == {(r["event_type"], r["t"]): tuple(r)[2:] for r in batch.collect()}


def test_stream_features_and_cooldown(spark, tmp_path):
    rows = [("A", at(i), 100.0 + i % 3) for i in range(40)] + [("A", at(40), 200.0)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = pipeline.file_stream(spark, f"{tmp_path}/in", "symbol string, ts timestamp, price double")
    drained(pipeline.run(stateful.rolling_features(stream), f"{tmp_path}/c1", path=f"{tmp_path}/features"))
    got = spark.read.parquet(f"{tmp_path}/features").orderBy("ts").collect()
    assert len(got) == 41 and got[-1]["is_jump"] and got[-1]["is_outlier"] and got[18]["sma_20"] is None
    assert got[20]["sma_20"] == pytest.approx(np.mean([100.0 + i % 3 for i in range(1, 21)]))
    alerts_ = stream.select(F.col("symbol").alias("rule"), "ts", F.col("price").alias("value"))
    drained(pipeline.run(stateful.with_cooldown(alerts_, 6 * 3600), f"{tmp_path}/c2", path=f"{tmp_path}/alerts"))
    assert [r["ts"] for r in spark.read.parquet(f"{tmp_path}/alerts").orderBy("ts").collect()] == [at(h) for h in range(0, 41, 6)]


def test_tick_features_do_not_depend_on_batches():
    prices = [float(100 + (i * 7) % 13) for i in range(60)]
    _, whole = stateful.tick_features([], prices)
    history, parts = [], []
    for i in range(0, 60, 9):
        history, found = stateful.tick_features(history, prices[i : i + 9])
        parts += found
    assert whole == parts


def test_support_and_resistance_match_brute_force():
    rng = np.random.default_rng(5)
    x = 100 + rng.normal(0, 3, 5000)
    got = kernels.support_resistance(x)
    for kind, sign in (("resistance", 1), ("support", -1)):
        peaks = [(i, sign * v) for i, v in kernels.spaced_peaks(sign * x, 12)]
        want = {(i, v, n) for i, v in peaks if (n := sum(abs(w - v) < v * 0.02 for _, w in peaks)) >= 2}
        own = [r for r in got if r[1] == kind]
        assert {(r[0], r[2], r[3]) for r in own} == want
        ahead = [r[4] for r in own if r[4] > 0]
        assert [r[4] for r in own if r[5]] == [min(ahead)] * sum(r[4] == min(ahead) for r in own) if ahead else not any(r[5] for r in own)


def test_bootstrap_does_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.normal(10, 2, 900))]
    df = spark.createDataFrame(rows, "i long, k string, v double")
    one, many = [{r["k"]: (round(r["low"], 9), round(r["high"], 9)) for r in robust.bootstrap_means(x, "v", "k", "i").collect()} for x in (df.coalesce(1), df.repartition(7))]
    assert one == many
    for k, (low, high) in one.items():
        v = np.array([x for _, g, x in rows if g == k])
        half = 1.96 * v.std(ddof=1) / np.sqrt(len(v))
        assert abs(low - (v.mean() - half)) < 0.25 * half and abs(high - (v.mean() + half)) < 0.25 * half


def test_spearman_has_no_global_window_over_values(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 50, 3000).astype(float)
    b = a + rng.normal(0, 20, 3000).round()
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    got = correlation.spearman(df, "a", "b").first()
    want = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert abs(got["spearman"] - want) < 1e-12


def test_walk_forward_gives_each_key_the_folds_it_holds(spark):
    df = spark.range(1000).selectExpr("'a' AS k", "id AS t").union(spark.range(100).selectExpr("'b'", "id"))
    rows = predictions.walk_forward(df, Window.partitionBy("k").orderBy("t"), 50, 20, gap=5).collect()
    got = {}
    for r in rows:
        got.setdefault((r["k"], r["fold"], r["part"]), []).append(r["t"])
    for k, n in (("a", 1000), ("b", 100)):
        plan = predictions.folds(n, 50, 20, gap=5)
        assert {f for key, f, _ in got if key == k} == {f[0] for f in plan}
        for f, a, b, c, d in plan:
            assert sorted(got[k, f, "train"]) == list(range(a - 1, b)) and sorted(got[k, f, "test"]) == list(range(c - 1, d))
