"""Tables and the logical series built from them.

All series carry a key ``k``, so that windows partition by it, and an order (``t``, with a
tie key where needed). Bars reduce events before anything is windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``ts`` as a timestamp."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events_: DataFrame, unit: str = "hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(k, t, open, high, low, close, volume): OHLCV of the values, ties in time broken by event_id."""
    at = F.struct("ts", "event_id")
    key: Column = F.concat_ws("|", *keys) if keys else F.lit("all")
    return events_.groupBy(key.alias("k"), F.date_trunc(unit, "ts").alias("t")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(events(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(events(spark, sf_dir), "day")


def by_time() -> WindowSpec:
    """Each key's rows in time."""
    return Window.partitionBy("k").orderBy("t")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: (k, t, price, size, side, is_maker, order keys)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("k"), F.col("l_shipdate").cast("timestamp").alias("t"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
        F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"),
        (F.col("l_linestatus") == "F").alias("is_maker"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def whales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as large transfers: (exchange, t, amount, direction, address, seq)."""
    flow = F.when(F.col("o_orderstatus") == "F", "inflow").when(F.col("o_orderstatus") == "O", "outflow").otherwise("internal")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("exchange"), F.col("o_orderdate").cast("timestamp").alias("t"),
        F.col("o_totalprice").alias("amount"), flow.alias("direction"), F.col("o_custkey").alias("address"), F.col("o_orderkey").alias("seq"),
    )


def spine(df: DataFrame, step: str = "1 hour", key: str = "k", at: str = "t") -> DataFrame:
    """(k, t): every step between each key's first and last time."""
    ends = df.groupBy(key).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return ends.select(key, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(at))
