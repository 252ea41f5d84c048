"""Rules on awkward rows: nulls, empty tables, short and constant series."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import outliers, predictions, regimes, text
from tidewater.sinks import upsert


def by_t():
    return Window.partitionBy("k").orderBy("t")


def rows(spark, values, k="a"):
    return spark.createDataFrame([(k, t, None if v is None else float(v)) for t, v in enumerate(values)], "k string, t long, x double")


def test_volatility_of_short_and_flat_series(spark):
    frame = rows(spark, [0.1, None, -0.1], "short").union(rows(spark, [0.01] * 30, "flat")).union(rows(spark, [0.3 * (-1) ** i * (1 + i % 7) for i in range(40)], "wild"))
    got = {r["k"]: r for r in regimes.volatility_persistence(frame, "x", by_t()).collect()}
    assert (got["short"]["class"], got["short"]["persistence"]) == ("high", 0.5)
    assert (got["flat"]["class"], got["flat"]["persistence"]) == ("very_low", 0.5)
    assert got["wild"]["class"] == "extreme" and 0 <= got["wild"]["persistence"] <= 1
    assert spark.range(1).select(regimes.volatility_class(F.lit(None).cast("double")).alias("c")).first()["c"] is None


def test_drift_waits_for_a_full_window(spark):
    got = predictions.drift(rows(spark, [1.0] * 6 + [3.0] * 2), ["x"], by_t(), window=4, bound=1.0).orderBy("t").collect()
    assert [r["drifted"] for r in got] == [False] * 7 + [True] and got[2]["x_drift"] is None and got[7]["x_drift"] == 2.0


def test_holdout_cuts_in_order(spark):
    got = [r["part"][:2] for r in predictions.holdout(rows(spark, range(7)), by_t()).orderBy("t").collect()]
    assert got == ["tr"] * 4 + ["va"] + ["te"] * 2
    assert predictions.holdout(rows(spark, [1.0]), by_t()).first()["part"] == "test"


def test_clips_and_filters_on_nulls(spark):
    frame = rows(spark, [None, 1, 2, 3, 100]).union(rows(spark, [None], "none"))
    got = {(r["k"], r["t"]): r["x"] for r in outliers.clip_beyond_tails(frame, "x", ["k"], 0.25, 0.75, 1.0).collect()}
    assert got["a", 0] is None and got["none", 0] is None and got["a", 1] == 1 and got["a", 4] < 100
    table = spark.createDataFrame([(1, "Buy BTC 100%", "x"), (2, None, "x"), (3, "buy_eth", None)], "id int, command string, user string")
    assert {r["id"] for r in text.matching(table, {"command": "BUY"}).collect()} == {1, 3}
    assert {r["id"] for r in text.matching(table, {"command": "100%"}, {"user": "x"}).collect()} == {1}
    assert {r["id"] for r in text.matching(table, {"command": "y_e"}).collect()} == {3}  # no wildcards
    assert text.matching(table, {"command": None}, {"user": None}, ("id", 2), 1).count() == 1


def test_cache_entries_expire(spark):
    t = dt.datetime(2024, 1, 1)
    table = spark.createDataFrame([("a", t, 1.0), ("a", t + dt.timedelta(seconds=50), 2.0), ("b", t - dt.timedelta(seconds=400), 3.0), ("c", None, 4.0)], "k string, ts timestamp, v double")
    assert [(r["k"], r["v"]) for r in upsert.latest_within(table, ["k"], "ts", t + dt.timedelta(seconds=60), 300).collect()] == [("a", 2.0)]
    assert upsert.latest_within(table.limit(0), ["k"], "ts", t).count() == 0
