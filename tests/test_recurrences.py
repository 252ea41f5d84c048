"""Recurrences in blocks against row-by-row loops, over batches of any size and with missing values; entropies, filters, drawdowns."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.columns import gaussian_filter, median_filter, rolling_central_moment
from tidewater.operators import ewm, neighbours, outliers, risk, significance


def series(spark, values, k="a"):
    return spark.createDataFrame([(k, t, None if v is None or v != v else float(v)) for t, v in enumerate(values)], "k string, t long, x double")


def by_t():
    return Window.partitionBy("k").orderBy("t")


def column(df, name):
    return [math.nan if r[name] is None else r[name] for r in df.where("k = 'a'").orderBy("t").collect()]


@pytest.fixture(params=[10_000, 7])
def batches(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def noisy(n, seed, missing=0.15):
    rng = random.Random(seed)
    return [math.nan if rng.random() < missing else rng.gauss(0, 1) for _ in range(n)]


def test_decayed_is_the_recurrence():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 300):
        for a in (0.0, 0.5, 0.999):
            b, y, want = rng.normal(size=n), 3.0, []
            for v in b:
                y = a * y + v
                want.append(y)
            assert np.allclose(ewm.decayed(a, b, 3.0), want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("adjust", [True, False])
def test_means_with_gaps_match_pandas(spark, batches, adjust):
    x = [math.nan, math.nan, *noisy(200, 3)]
    df = series(spark, x).union(series(spark, [None, None], "empty"))
    got = column(ewm.ewm(df, "x", "y", span=9, adjust=adjust), "y")
    assert np.allclose(got, pd.Series(x).ewm(span=9, adjust=adjust, ignore_na=True).mean(), equal_nan=True)


def test_macd_in_one_pass(spark, batches):
    x = pd.Series(noisy(150, 4)).cumsum().ffill()
    got = ewm.macd(series(spark, x), "x")
    line = x.ewm(span=12, ignore_na=True).mean() - x.ewm(span=26, ignore_na=True).mean()
    signal = line.ewm(span=9, ignore_na=True).mean()
    assert np.allclose(column(got, "macd"), line, equal_nan=True) and np.allclose(column(got, "macd_hist"), line - signal, equal_nan=True)
    assert got.columns == ["k", "t", "x", "macd_signal", "macd", "macd_hist"]


def test_variances_match_loops(spark, batches):
    x = noisy(120, 5)
    want, seen, v = [], [], None
    for r in x:
        if r != r:
            want.append(math.nan)
            continue
        if v is None:
            seen.append(r)
            v = float(np.var(seen, ddof=1)) if len(seen) == 20 else None
        else:
            v = 0.94 * v + 0.06 * r * r
        want.append(math.nan if v is None else v)
    assert np.allclose(column(ewm.riskmetrics_variance(series(spark, x), "x", "y"), "y"), want, equal_nan=True)
    h, want = 1e-4, []
    for r in x:
        want.append(h)
        h = 1e-6 + 0.1 * (0 if r != r else r * r) + 0.85 * h
    assert np.allclose(column(ewm.garch_variance(series(spark, x), "x", "y"), "y"), want)


def test_cooldown_jumps_match_a_walk(spark, batches):
    rng = random.Random(6)
    times = sorted(rng.randrange(5000) for _ in range(150))
    df = spark.createDataFrame([("a", t) for t in times], "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    want, last = [], None
    for t in times:
        want.append(last is None or t - last >= 60)
        last = t if want[-1] else last
    got = sorted((r["s"], not r["emitted"]) for r in ewm.cooldown(df, 60).collect())
    assert [not b for _, b in got] == [w for _, w in sorted(zip(times, want), key=lambda p: (p[0], not p[1]))]


def test_vote_keeps_its_parts(spark):
    x = [*noisy(60, 7, 0), 50.0, None, -40.0]
    df = series(spark, x).union(series(spark, [1.0] * 5, "flat"))
    one = outliers.vote(df, "x", ["k"], 3.0, 3.0, 3.5)
    parts = outliers.with_modified_z(outliers.with_iqr_flag(outliers.with_z(df, "x", ["k"]), "x", ["k"], 3.0), "x", ["k"])
    names = ["k", "t", "z", "iqr_flag", "modified_z"]
    assert sorted(map(str, one.select(*names).collect())) == sorted(map(str, parts.select(*names).collect()))
    assert {r["x"] for r in one.where("votes >= 2").collect()} == {50.0, -40.0}


def test_entropies_match_all_pairs(spark):
    x = np.round(noisy(80, 8, 0), 2)

    def near(m):
        v = np.stack([x[i : i + m] for i in range(len(x) - m + 1)])
        return np.abs(v[:, None] - v[None]).max(2) < 0.3 * x.std()

    two, three = near(2), near(3)
    got = neighbours.pair_entropies(series(spark, x), "x", by_t(), 2, 0.3).first()
    assert math.isclose(got["approximate"], np.log(two.mean(1)).mean() - np.log(three.mean(1)).mean(), rel_tol=1e-9)
    assert math.isclose(got["sample"], -math.log((three.sum() - len(three)) / (two.sum() - len(two))), rel_tol=1e-9)
    scales = {r["scale"]: r["sample"] for r in neighbours.multiscale_entropy(series(spark, x), "x", by_t(), [1, 3], 2, 0.3).collect()}
    assert scales[1] == got["sample"] and 3 in scales


def test_filters_mirror_the_ends(spark):
    for n in (1, 2, 3, 30):
        x = np.array(noisy(n, n, 0))
        padded = np.pad(x, 4, mode="symmetric")
        taps = np.exp(-0.5 * np.arange(-4, 5) ** 2)
        df = series(spark, x).select("k", "t", median_filter("x", by_t()).alias("m"), gaussian_filter("x", by_t()).alias("g"))
        assert np.allclose(column(df, "m"), [np.median(padded[i + 2 : i + 7]) for i in range(n)])
        assert np.allclose(column(df, "g"), [(padded[i : i + 9] * taps).sum() / taps.sum() for i in range(n)])
    got = column(series(spark, [1.0, 2.0, 4.0, 8.0]).select("k", "t", rolling_central_moment("x", by_t(), 3, 3).alias("m")), "m")
    assert np.allclose(got, [math.nan, math.nan, *[np.mean((np.array(w) - np.mean(w)) ** 3) for w in ([1, 2, 4], [2, 4, 8])]], equal_nan=True)


def test_drawdowns_and_tails(spark):
    r = [0.1, -0.5, 0.2, 1.0, -0.1, None, 0.05, 0.2]
    got = risk.drawdown_report(series(spark, r).union(series(spark, [0.1] * 3, "up")), "x", by_t()).collect()
    a, up = sorted(got, key=lambda row: row["k"])
    assert (a["start"], a["trough"], a["recovery"], a["periods"]) == (0, 1, 3, 2) and math.isclose(a["max_drawdown"], -0.5)
    assert math.isclose(a["underwater"], 5 / 8) and math.isclose(a["frequency"], 2 / 8) and math.isclose(a["mean_length"], 2.5)
    assert (up["max_drawdown"], up["start"], up["recovery"], up["periods"]) == (0.0, None, None, 0)
    x = [-9, -8, 1, 3, -7, 2, 9, 8, 0, -5]
    tails = risk.tail_dependence(series(spark, x), "x", by_t(), share=0.4).first()
    low, high = np.quantile(x, 0.4), np.quantile(x, 0.6)
    after = lambda beyond: sum(beyond(a) and beyond(b) for a, b in zip(x, x[1:])) / sum(map(beyond, x[:-1]))
    assert math.isclose(tails["lower"], after(lambda v: v < low)) and math.isclose(tails["upper"], after(lambda v: v > high))


def test_normality_of_known_samples(spark):
    rng = np.random.default_rng(9)
    frame = series(spark, rng.normal(size=400)).union(series(spark, rng.exponential(size=400), "skewed")).union(series(spark, [1.0] * 20, "flat")).union(series(spark, [1, 2, 3], "short"))
    got = {r["k"]: r for r in significance.normality(frame, "x", ["k"]).collect()}
    assert got["a"]["dagostino_p"] > 0.01 and got["a"]["jarque_bera_p"] > 0.01 and got["skewed"]["dagostino_p"] < 1e-6
    assert got["flat"]["dagostino"] is None and got["short"]["jarque_bera"] is None
