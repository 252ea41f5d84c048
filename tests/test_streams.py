"""Streams over several micro-batches and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.streaming import alerts, pipeline

T0 = dt.datetime(2024, 1, 1)
CHECKS = "rule string, ts timestamp, firing boolean, value double, action string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def feed(spark, folder, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def run_all(stream, where):
    pipeline.run(stream, f"{where}/checkpoint", path=f"{where}/out").awaitTermination()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, alerts.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_alert_life_over_batches_and_a_restart(spark, tmp_path, rocks):
    batches = [
        [("a", at(0), True, 5.0, None), ("a", at(60), True, 9.0, None), ("b", at(10), False, 1.0, None)],
        [("a", at(400), True, 6.0, None), ("b", at(420), True, 2.0, None), ("b", at(430), True, 3.0, "acknowledge"), ("b", at(900), True, 8.0, None)],
        [("a", at(1000), False, 1.0, None), ("a", at(1010), True, 7.0, None), ("c", at(1000), True, 4.0, None)],
        [("a", at(1020), False, 1.0, "resolve"), ("a", at(1500), True, 7.0, None), ("a", at(30), True, 99.0, None)],
        [("d", at(9000), False, 0.0, None)],
        [("d", at(9900), False, 0.0, None)],
    ]
    for n, rows in enumerate(batches):  # each batch in a run of its own: state and timers outlive the query
        feed(spark, tmp_path / "in", rows, CHECKS, n)
        stream = spark.readStream.schema(CHECKS).parquet(f"{tmp_path}/in/*")
        run_all(alerts.alert_life(stream, cooldown=300, expiry=3600, late="60 seconds"), tmp_path)
    got = sorted((r["rule"], r["ts"], r["alert"], r["status"], r["firings"], r["peak"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        ("a", at(0), 1, "opened", 1, 5.0),
        ("a", at(400), 1, "repeated", 3, 9.0),
        ("a", at(1000), 1, "resolved", 3, 9.0),
        ("a", at(1010), 2, "opened", 1, 7.0),
        ("a", at(1020), 2, "resolved", 1, 7.0),
        ("a", at(1500), 3, "opened", 1, 7.0),
        ("a", at(5100), 3, "expired", 1, 7.0),
        ("b", at(420), 1, "opened", 1, 2.0),
        ("b", at(430), 1, "acknowledged", 1, 2.0),
        ("b", at(4500), 1, "expired", 2, 8.0),
        ("c", at(1000), 1, "opened", 1, 4.0),
        ("c", at(4600), 1, "expired", 1, 4.0),
    ]


def test_stream_join_equals_the_batch_join_and_drops_late_rows(spark, tmp_path):
    rng = random.Random(3)
    trades = [(rng.choice("ab"), at(rng.randrange(i * 900, (i + 1) * 900)), float(i)) for i in range(4) for _ in range(15)]
    quotes = [(rng.choice("ab"), at(rng.randrange(i * 900, (i + 1) * 900)), float(-i)) for i in range(4) for _ in range(15)]
    one, two = "k string, ts timestamp, price double", "k string, ts timestamp, quote double"
    for i in range(4):
        feed(spark, tmp_path / "t", trades[i * 15 : (i + 1) * 15], one, i)
        feed(spark, tmp_path / "q", quotes[i * 15 : (i + 1) * 15], two, i)
        streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{f}/*") for f, s in (("t", one), ("q", two))]
        run_all(pipeline.joined(*streams, within="5 minutes", late="20 minutes"), tmp_path)
    # far beyond all watermarks: rows that are later than allowed find nothing
    for i, ts in ((4, at(20_000)), (5, at(30_000)), (6, trades[0][1])):
        feed(spark, tmp_path / "t", [("a", ts, 100.0)], one, i)
        feed(spark, tmp_path / "q", [("a", ts, 100.0)], two, i)
        streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{f}/*") for f, s in (("t", one), ("q", two))]
        run_all(pipeline.joined(*streams, within="5 minutes", late="20 minutes"), tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    all_rows = pipeline.joined(spark.createDataFrame(trades, one), spark.createDataFrame(quotes, two), within="5 minutes").collect()
    assert got == sorted([*map(tuple, all_rows), *(("a", at(s), 100.0, at(s), 100.0) for s in (20_000, 30_000))])
    assert all_rows


def test_stream_join_tells_trades_without_a_quote(spark, tmp_path):
    one, two = "k string, ts timestamp, price double", "k string, ts timestamp, quote double"
    steps = [([("a", at(0), 1.0), ("a", at(100), 2.0)], [("a", at(90), 9.0)]), ([("a", at(5000), 3.0)], [("a", at(5000), 8.0)]), ([("a", at(9000), 4.0)], [("a", at(9000), 7.0)])]
    for i, (t, q) in enumerate(steps):
        feed(spark, tmp_path / "t", t, one, i)
        feed(spark, tmp_path / "q", q, two, i)
        streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{f}/*") for f, s in (("t", one), ("q", two))]
        run_all(pipeline.joined(*streams, within="1 minute", late="10 seconds", how="leftOuter"), tmp_path)
    got = sorted((r["price"], r["quote"]) for r in spark.read.parquet(f"{tmp_path}/out").where(F.col("trade_ts") < F.lit(at(6000))).collect())
    assert got == [(1.0, None), (2.0, 9.0), (3.0, 8.0)]
