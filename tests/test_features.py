"""Dependence tests, extrapolation and local lines on awkward rows, and against brute force."""

import math

import pytest

from tidewater.operators import fill, risk, significance
from tidewater.sources.tables import by_time

SCHEMA = "k string, t int, x double, y double"


def rows_of(df, *names):
    return {tuple(r[n] for n in ("k", "t")): tuple(r[n] for n in names) for r in df.collect()}


def test_extrapolation_past_both_ends(spark):
    data = [("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, 7.0), ("a", 5, None), ("one", 0, None), ("one", 1, 5.0), ("none", 0, None)]
    got = rows_of(fill.extrapolate(spark.createDataFrame(data, "k string, t int, x double"), "x", by_time()), "x")
    assert [got["a", t][0] for t in range(6)] == pytest.approx([0.0, 2.0, 4.0, 6.0, 7.0, 8.0])
    assert got["one", 0] == got["one", 1] == (5.0,)
    assert got["none", 0] == (None,)


def test_local_line_equals_brute_force(spark):
    x = [10 + 3 * math.sin(i) for i in range(40)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", 0, 4.0), ("b", 1, None)], "k string, t int, x double")
    got = rows_of(fill.local_line(df, "x", by_time()), "trend")
    h = math.ceil(0.3 * len(x))
    for i in range(len(x)):
        near = range(max(0, i - h // 2), min(len(x), i + h // 2 + 1))
        w = {j: 1 - abs(j - i) / h for j in near}
        slope = sum(w[j] * j * x[j] for j in near) / sum(w[j] * j * j for j in near)
        assert got["a", i][0] == pytest.approx(slope * i)
    assert got["b", 0] == (4.0,)


def test_constant_short_and_empty_series(spark):
    data = [("flat", i, 1.0, 1.0) for i in range(20)] + [("short", 0, 1.0, 2.0), ("short", 1, None, 3.0)]
    o = by_time()
    for df in (spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], SCHEMA)):
        n = df.select("k").distinct().count()
        assert all(r["x_to_y"] is None or math.isnan(r["x_to_y"]) for r in significance.granger(df, "x", "y", o, ["k"]).collect())
        assert significance.ljung_box(df, "x", o, 10, ["k"]).count() == n
        halves = df.selectExpr("k", "x", "t % 2 AS g")
        assert all(r["levene"] is None and r["bartlett"] is None for r in significance.equal_variance(halves, "x", "g", ["k"]).collect())
        assert significance.two_components(df, "x", "y", ["k"]).count() == n
        assert risk.tail_value_at_risk(df, "x", ["k"]).count() == 0
        mi = significance.mutual_information(significance.equal_bins(df, "x", 5, ["k"], "b"), "b", "b", ["k"])
        assert all(r["mi"] == pytest.approx(0.0) for r in mi.collect())


def test_selection_and_augmentation_on_awkward_rows(spark):
    """Empty tables, keys of one row, null keys and values, constant columns."""
    from pyspark.sql import functions as F

    from tidewater.operators import augment, correlation, market
    from tidewater.sources.tables import by_time

    schema = "k string, t int, x double, y double, extra string"
    rows = [("a", i, 5.0, float(i) if i % 4 else None, "e") for i in range(25)] + [("b", 0, None, 1.0, None), (None, 0, 1.0, 2.0, None), (None, 1, 3.0, 2.0, None)]
    for given in ([], rows):
        df = spark.createDataFrame(given, schema)
        stable = {(r["k"], r["feature"]): r for r in correlation.rolling_stability(df, ["x", "y"], "t").collect()}
        informative = correlation.most_informative(df, ["y"], "x", 2).collect()
        noisy = augment.noise(df, ["x", "y"], F.col("t")).collect()
        wide = augment.magnitude(df, ["x", "y"], by_time(), 2.0).collect()
        warped = augment.time_warp(df, ["x", "y"], "t").collect()
        assert len(noisy) == len(wide) == len(given)
        if not given:
            assert not stable and not informative and not warped
            continue
        assert set(stable) == {(k, f) for k in ("a", "b", None) for f in ("x", "y")}
        assert stable["a", "x"]["score"] == 0.0 and not stable["a", "x"]["stable"]  # a constant has no deviation
        assert stable["b", "x"]["score"] is None and stable["b", "x"]["stable"]
        assert all(r["x"] == 5.0 for r in noisy if r["k"] == "a") and sum(r["y"] is None for r in noisy) == 7
        assert sorted(r["x"] for r in wide if r["k"] is None) == [0.0, 4.0]
        assert [r["j"] for r in sorted((r for r in warped if r["k"] == "a"), key=lambda r: r["j"])] == list(range(22))
        assert len([r for r in warped if r["k"] == "b"]) == 1 and len([r for r in warped if r["k"] is None]) == 2

    books = spark.createDataFrame([("a", True, 10.0, 3.0), ("a", False, 9.0, 1.0), ("b", True, 1.0, 1.0), (None, True, 2.0, None), (None, False, 2.0, 4.0)], "k string, ask boolean, price double, size double")
    got = {r["k"]: r for r in market.book_depth(books, "k").collect()}
    assert set(got) == {"a", None} and got["a"]["bid_0"] == 1.0 and got["a"]["ask_0"] == 3.0 and got[None]["imbalance_4"] == 1.0
    assert market.book_depth(books.limit(0), "k").count() == 0


def test_noise_is_the_same_in_any_partitioning(spark):
    from pyspark.sql import functions as F

    from tidewater.operators import augment

    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    one, two = (sorted(tuple(r) for r in augment.noise(df.repartition(n), ["x"], F.col("t"), seed=3).select("t", F.round("x", 6)).collect()) for n in (1, 7))
    assert one == two and one != sorted((t, float(t)) for t in range(500))


def test_simulated_paths_equal_brute_force(spark):
    import zlib

    import numpy as np

    from tidewater.operators import kernels

    stats = spark.createDataFrame([("a", 0.01, 0.1), ("b", None, 0.2)], "k string, m double, s double")
    got = {(r["k"], r["path"], r["step"]): r["value"] for r in kernels.simulated_paths(stats, "k", "m", "s", paths=300, steps=4).collect()}
    assert len(got) == 2 * 300 * 4 and all(v is None or np.isnan(v) for (k, _, _), v in got.items() if k == "b")
    for path in (0, 7, 299):
        value = 1.0
        for step, z in enumerate(np.random.default_rng([42, path, zlib.crc32(b"a")]).standard_normal(4), 1):
            value *= 1 + 0.01 + 0.1 * z
            assert abs(got["a", path, step] - value) < 1e-12
    assert kernels.simulated_paths(stats.limit(0), "k", "m", "s", 5, 5).count() == 0
