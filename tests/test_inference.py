"""Distributions, least squares, neighbour joins, stationarity, imputation, intervals and predictions against brute force."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import distributions as dist
from tidewater.functions import linear
from tidewater.operators import fill, neighbours, predictions, regimes, robust, significance, stationarity


def o():
    return Window.partitionBy("k").orderBy("t")


def simpson(f, a, b, n=4000):
    h = (b - a) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


def beta(x, a, b):
    whole = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def f(t):
        s, c = math.sin(t), math.cos(t)
        if s <= 0:
            return 0.0 if 2 * a > 1 else math.exp(-whole)
        return math.exp((2 * a - 1) * math.log(s) + (2 * b - 1) * math.log(c) - whole) if c > 0 else 0.0

    return 2 * simpson(f, 0, math.asin(math.sqrt(x)))


def chi_tail(x, k):
    f = lambda s: math.exp((k - 1) * math.log(s) - s * s / 2 - (k / 2 - 1) * math.log(2) - math.lgamma(k / 2)) if s > 0 else (0.0 if k > 1 else math.sqrt(2 / math.pi))
    return simpson(f, math.sqrt(x), math.sqrt(x) + 40, 8000)


def series(spark, values, k="a"):
    return spark.createDataFrame([(k, t, None if v is None else float(v)) for t, v in enumerate(values)], "k string, t long, x double")


def test_p_values_match_integrals(spark):
    rows = [(t, float(n)) for t in (0.0, 0.3, -2.5, 9.0) for n in (1, 2, 7, 300)]
    for r in spark.createDataFrame(rows, "t double, n double").select("t", "n", dist.t_p("t", "n").alias("p")).collect():
        assert abs(r["p"] - beta(r["n"] / (r["n"] + r["t"] ** 2), r["n"] / 2, 0.5)) < 1e-9
    rows = [(f, float(m), float(n)) for f in (0.01, 1.0, 4.0) for m in (1, 3, 200) for n in (2, 90, 700)]
    for r in spark.createDataFrame(rows, "f double, m double, n double").select("f", "m", "n", dist.f_p("f", "m", "n").alias("p"), dist.f_p_two_sided("f", "m", "n").alias("q")).collect():
        p = beta(r["n"] / (r["n"] + r["m"] * r["f"]), r["n"] / 2, r["m"] / 2)
        assert abs(r["p"] - p) < 1e-9 and abs(r["q"] - 2 * min(p, 1 - p)) < 1e-9
    rows = [(x, k) for x in (0.0, 0.5, 6.0, 400.0) for k in (1, 2, 10, 500)]
    for r in spark.createDataFrame(rows, "x double, k int").select("x", "k", dist.chi2_p("x", "k").alias("p")).collect():
        assert abs(r["p"] - chi_tail(r["x"], r["k"])) < 1e-9
    normal = statistics.NormalDist()
    for r in spark.createDataFrame([(v,) for v in (1e-9, 0.01, 0.2, 0.5, 0.97, 0.9999)], "p double").select("p", dist.normal_quantile("p").alias("z"), dist.normal_cdf(dist.normal_quantile("p")).alias("back")).collect():
        assert abs(r["z"] - normal.inv_cdf(r["p"])) < 1e-9 and abs(r["back"] - r["p"]) < 1e-12


def test_p_values_of_nothing_are_null(spark):
    null = F.lit(None).cast("double")
    one = F.lit(1.0)
    got = spark.range(1).select(dist.t_p(null, one), dist.f_p(one, null, one), dist.chi2_p(null, one), dist.normal_quantile(null), dist.beta_cdf(F.lit(0.5), F.lit(0.0), one), dist.gamma_tail(F.lit(-1.0), one), dist.t_p(one, F.lit(0.0)), dist.f_p(null, one, one), dist.f_p_two_sided(null, one, one)).first()
    assert list(got) == [None] * 9
    assert list(spark.range(1).select(dist.f_p(F.lit(float("inf")), one, one), dist.chi2_p(F.lit(float("inf")), one), dist.normal_quantile(F.lit(1.0))).first()) == [0.0, 0.0, float("inf")]


def test_least_squares_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((60, 1)), rng.normal(size=(60, 4))])
    y = x @ np.arange(1.0, 6.0) + rng.normal(size=60)
    names = list("abcde")
    df = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(x, y)], ", ".join(f"{n} double" for n in [*names, "y"]))
    xx, xy, yy = linear.moments([F.col(n) for n in names], F.col("y"))
    sums = df.agg(xx.alias("xx"), xy.alias("xy"), yy.alias("yy"))
    for ridge in (0.0, 3.0):
        b, inverse = linear.solve(F.col("xx"), F.col("xy"), ridge)
        got = sums.select(b.alias("b"), inverse.alias("i")).first()
        a = x.T @ x + np.diag([0] + [ridge] * 4)
        assert np.allclose(got["b"], np.linalg.solve(a, x.T @ y), atol=1e-10) and np.allclose(got["i"], np.diag(np.linalg.inv(a)), atol=1e-12)
    b, _ = linear.solve(F.array(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))), F.array(F.lit(1.0), F.lit(1.0)))
    assert spark.range(1).select(b.alias("b")).first()["b"] == [None, None]


@pytest.mark.parametrize(("metric", "size"), [("max", 1), ("max", 3), ("euclid", 2), ("euclid", 20)])
def test_neighbour_pairs_match_all_pairs(spark, metric, size):
    rng = random.Random(size)
    rows = [(i, rng.choice("ab"), [rng.gauss(0, 1) for _ in range(size)]) for i in range(150)] + [(200 + i, "a", [0.01 * i] * size) for i in range(40)]
    rows += [(300, "a", None), (301, "a", [None] * size), (302, "b", [5.0] * size), (303, "b", [5.0] * size)]
    radius = 0.5 if size < 20 else 4.5
    df = spark.createDataFrame(rows, "id long, k string, v array<double>")
    found = neighbours.neighbour_pairs(df, "id", "v", size, radius, ["k"], metric, cell_rows=7)
    gap = (lambda a, b: max(abs(x - y) for x, y in zip(a, b))) if metric == "max" else math.dist
    good = [r for r in rows if r[2] and None not in r[2]]
    want = sorted((k, i, j) for i, k, v in good for j, kk, w in good if k == kk and i < j and gap(v, w) < radius)
    assert sorted((r["k"], r["a"], r["b"]) for r in found.collect()) == want and want
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_recurrence_matches_the_plot(spark):
    rng = np.random.default_rng(4)
    x = np.round(np.sin(np.arange(90) / 3) + rng.normal(size=90) / 10, 3)
    v = np.stack([x[i : i + 3] for i in range(88)])
    plot = np.linalg.norm(v[:, None] - v[None], axis=2) < 0.3 * x.std()
    lines = []
    for k in range(-87, 88):
        run = 0
        for on in [*np.diag(plot, k), False]:
            if on:
                run += 1
            elif run:
                lines.append((k, run))
                run = 0
    long = [n for _, n in lines if n >= 2]
    got = neighbours.recurrence(series(spark, x).union(series(spark, [1.0] * 30, "flat")), "x", o(), 3, 0.3).collect()
    assert [r["k"] for r in got] == ["a"]
    assert math.isclose(got[0]["recurrence_rate"], plot.mean()) and math.isclose(got[0]["determinism"], sum(long) / plot.sum())
    assert math.isclose(got[0]["average_diagonal"], np.mean(long)) and got[0]["longest_diagonal"] == max(n for k, n in lines if k)


@pytest.mark.parametrize(("lags", "trend"), [(0, "c"), (1, "c"), (3, "ct")])
def test_unit_root_matches_least_squares(spark, lags, trend):
    rng = np.random.default_rng(lags)
    x = 1e4 + rng.normal(size=120).cumsum()
    d = np.diff(x)
    rows = range(lags + 1, len(x))
    a = np.array([[1.0, x[t - 1], *([t + 1] if trend == "ct" else []), *[d[t - 1 - j] for j in range(1, lags + 1)]] for t in rows])
    y = np.array([d[t - 1] for t in rows])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    s2 = ((y - a @ b) ** 2).sum() / (len(y) - a.shape[1])
    centred = a - np.where(np.arange(a.shape[1]) == 1, x.mean(), 0)
    want = b[1] / math.sqrt(s2 * np.linalg.inv(centred.T @ centred)[1, 1])
    frame = series(spark, [*x[:50], None, *x[50:]]).union(series(spark, [3.0] * 60, "flat")).union(series(spark, [1, 2, 4], "short")).union(series(spark, range(50), "line"))
    got = {r["k"]: r for r in stationarity.unit_root(frame, "x", o(), ["k"], lags, trend).collect()}
    assert math.isclose(got["a"]["adf"], want, rel_tol=1e-6) and got["a"]["n"] == len(y)
    assert all(got[k]["adf"] is None and got[k]["critical_5"] is None and got[k]["is_stationary"] is None for k in got if k != "a")
    noise = stationarity.unit_root(series(spark, rng.normal(size=300)), "x", o(), ["k"], lags, trend).first()
    assert noise["is_stationary"] and noise["critical_1"] < noise["critical_5"] < noise["critical_10"]


def test_kpss_matches_its_formula(spark):
    x = np.random.default_rng(7).normal(size=80).cumsum()
    e = x - x.mean()
    long_run = (e @ e + 2 * sum((1 - j / 13) * (e[j:] @ e[:-j]) for j in range(1, 13))) / 80
    want = (e.cumsum() ** 2).sum() / 80**2 / long_run
    got = {r["k"]: r for r in stationarity.kpss(series(spark, x).union(series(spark, [2.0] * 40, "flat")).union(series(spark, [1, 2], "short")), "x", o(), ["k"]).collect()}
    assert math.isclose(got["a"]["kpss"], want, rel_tol=1e-9) and 0.01 <= got["a"]["p"] <= 0.1
    assert got["flat"]["kpss"] is None and got["short"]["p"] is None


def test_knn_windows_match_brute_force(spark):
    rng = random.Random(5)
    x = [None if rng.random() < 0.3 else float(rng.randrange(6)) for _ in range(70)]
    want = list(x)
    ends = range(4, len(x))
    for i in ends:
        if x[i] is None:
            near = []
            for j in ends:
                if x[j] is not None:
                    both = [(a - b) ** 2 for a, b in zip(x[i - 4 : i + 1], x[j - 4 : j + 1]) if a is not None and b is not None]
                    if both:
                        near.append((round(sum(both) * 5 / len(both), 9), j))
            want[i] = sum(x[j] for _, j in sorted(near)[:3]) / len(sorted(near)[:3])
    for block in (512, 4):
        frame = series(spark, x).union(series(spark, [None] * 12, "empty"))
        got = fill.knn_windows(frame, "x", o(), window=5, k=3, block=block).orderBy("k", "t").collect()
        assert [r["filled"] for r in got if r["k"] == "a"] == pytest.approx(want, nan_ok=True)
        assert [r["filled"] for r in got if r["k"] == "empty"] == [None] * 12


def test_bca_interval_matches_the_jackknife(spark):
    rng = random.Random(6)
    rows = [(i, "a", rng.expovariate(1.0)) for i in range(80)] + [(100 + i, "flat", 2.0) for i in range(5)] + [(200, "a", None)]
    df = spark.createDataFrame(rows, "id long, k string, x double")
    got = {r["k"]: r for r in robust.bca_means(df, "x", "k", "id", replicates=400).collect()}
    x = np.array([v for _, k, v in rows if k == "a" and v is not None])
    jack = np.array([np.delete(x, i).mean() for i in range(len(x))])
    gap = jack.mean() - jack
    assert math.isclose(got["a"]["acceleration"], (gap**3).sum() / (6 * (gap**2).sum() ** 1.5), rel_tol=1e-6)
    hashes = df.where("k = 'a' AND x IS NOT NULL").orderBy("id").select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    w = robust.poisson_weights(hashes, 400, 42)
    means = np.sort(x @ w / w.sum(0))
    normal = statistics.NormalDist()
    z0, a = normal.inv_cdf((means < x.mean()).mean()), got["a"]["acceleration"]
    edges = [np.quantile(means, normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
    assert [got["a"]["low"], got["a"]["high"]] == pytest.approx(edges, rel=1e-9)
    assert got["flat"]["low"] == got["flat"]["high"] == 2.0


def test_fits_at_each_row_see_no_later_row(spark):
    rng = np.random.default_rng(8)
    x = 100 + rng.normal(size=140).cumsum()
    df = series(spark, x).withColumns({"f": F.col("x") - F.lag("x", 3).over(o()), "g": F.sin("x")})
    got = {r["t"]: r for r in predictions.fitted_at(df, "x", ["f", "g"], o(), horizon=5, ridge=0.5, history=40, every=7).collect()}
    f, g = np.full(140, np.nan), np.sin(x)
    f[3:] = x[3:] - x[:-3]
    for s in [t for t in range(140) if (t + 1) % 7 == 0 and t + 1 > 40 and t + 5 < 140]:
        i = np.arange(3, s - 4)
        a = np.stack([np.ones(len(i)), f[i], g[i]], axis=1)
        b = np.linalg.solve(a.T @ a + np.diag([0, 0.5, 0.5]), a.T @ (x[i + 5] / x[i] - 1))
        assert got[s]["n"] == len(i) and math.isclose(got[s]["predicted"], x[s] * (1 + b @ [1, f[s], g[s]]), rel_tol=1e-9) and got[s]["actual"] == x[s + 5]
    later = predictions.fitted_at(series(spark, [*x[:100], *[1.0] * 40]).withColumns({"f": F.col("x") - F.lag("x", 3).over(o()), "g": F.sin("x")}), "x", ["f", "g"], o(), horizon=5, ridge=0.5, history=40, every=7).collect()
    assert all(r["predicted"] == got[r["t"]]["predicted"] for r in later if r["t"] < 95)


def test_fold_scores_of_a_straight_line(spark):
    df = spark.createDataFrame([("a", t, float(t), 2.0 * t - 5) for t in range(60)] + [("b", t, 1.0, float(t)) for t in range(60)], "k string, t long, x double, y double")
    folds = predictions.walk_forward(df, o(), train=20, test=10, gap=2)
    summary = {(r["k"], r["metric"]): r for r in predictions.fold_summary(predictions.fold_scores(folds, "y", ["x"])).collect()}
    assert summary["a", "r2"]["test_mean"] == pytest.approx(1) and summary["a", "mae"]["train_mean"] == pytest.approx(0, abs=1e-9) and summary["a", "mae"]["folds"] == 3
    assert summary["b", "mae"]["test_mean"] is None  # a constant feature fits nothing


def test_weighted_predictions(spark):
    rules = {"vix": (25.0, -0.7, 0.05, 2.0), "flow": (1000.0, 0.4, 0.03, 6.0)}
    df = spark.createDataFrame([(1, "vix", 30.0), (1, "flow", -2000.0), (1, "else", 9.0), (2, "vix", 20.0), (2, "flow", None)], "g int, name string, value double")
    got = {r["g"]: r for r in predictions.indicator_prediction(df, rules, ["g"]).collect()}
    vix, flow = -0.7 * 0.05 * 30 / 25, 0.4 * 0.03 * -2
    assert got[1]["change"] == pytest.approx((vix * 70 + flow * 40) / 110) and got[1]["timeframe"] == int((2 * 70 + 6 * 40) / 110) and got[1]["confidence"] == pytest.approx(55)
    assert got[1]["triggers"] == ["flow=-2000.00", "vix=30.00"] and (got[2]["change"], got[2]["confidence"], got[2]["triggers"]) == (0, 0, [])
    methods = spark.createDataFrame([(1, "indicator", 0.02, 4.0, 55.0), (1, "pattern", -0.1, 24.0, 80.0), (1, "none", 1.0, 1.0, 0.0), (2, "indicator", 0.5, 1.0, 0.0)], "g int, method string, change double, timeframe double, confidence double")
    both = {r["g"]: r for r in predictions.confidence_ensemble(methods, {"indicator": 0.4, "pattern": 0.3}, ["g"]).collect()}
    w = [0.4 * 0.55, 0.3 * 0.8]
    assert both[1]["predicted_change"] == pytest.approx((0.02 * w[0] - 0.1 * w[1]) / sum(w)) and both[1]["timeframe_hours"] == int((4 * w[0] + 24 * w[1]) / sum(w))
    assert tuple(both[2])[1:] == (0.0, 6, 0.0)


def test_rank_sum_with_ties(spark):
    rng = random.Random(9)
    rows = [("a", float(rng.randrange(6)), rng.randrange(2)) for _ in range(60)] + [("flat", 1.0, i % 2) for i in range(6)] + [("a", None, 1)]
    got = {r["k"]: r for r in significance.rank_sum(spark.createDataFrame(rows, "k string, x double, g int"), "x", "g", ["k"]).collect()}
    x = [(v, g) for k, v, g in rows if k == "a" and v is not None]
    rank = {v: sum(w < v for w, _ in x) + (sum(w == v for w, _ in x) + 1) / 2 for v, _ in x}
    n, a = len(x), sum(g for _, g in x)
    ties = sum(t**3 - t for t in [sum(w == v for w, _ in x) for v in {v for v, _ in x}])
    z = (sum(rank[v] for v, g in x if g) - a * (n + 1) / 2) / math.sqrt(a * (n - a) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert math.isclose(got["a"]["rank_sum_z"], z, rel_tol=1e-9) and math.isclose(got["a"]["rank_sum_p"], 2 * (1 - statistics.NormalDist().cdf(abs(z))), rel_tol=1e-6)
    assert got["flat"]["rank_sum_z"] is None and got["flat"]["rank_sum_p"] is None


def test_risk_reaches_critical(spark):
    calm = [100.0 + 0.01 * (-1) ** i for i in range(200)]
    rows = [("a", i, v, 10.0, 20.0) for i, v in enumerate(calm)] + [("a", 200, 50.0, 60.0, 35.0)]
    df = spark.createDataFrame(rows, "k string, t long, x double, v double, other double")
    falls = {"day_fall": ("day", -0.5, 1.0)}
    got = regimes.composite_risk(df, "x", "v", "other", o(), falls).orderBy("t").collect()
    assert got[-1]["level"] == "CRITICAL" and got[-1]["pattern"] == pytest.approx(1.0, abs=0.01) and got[-2]["level"] == "LOW"
    assert abs(sum(regimes.RISK_WEIGHTS.values()) - 1) < 1e-12
