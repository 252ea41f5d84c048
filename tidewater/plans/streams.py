"""Streaming operators over the given tables, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..streaming import alerts, pipeline
from .registry import query, rounded


def _events(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.file_stream(spark, d, names="events.parquet")


@query("stream_join", """WITH a AS (SELECT user_id AS k, ts AS trade_ts, value AS price FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id AS k, ts AS quote_ts, value AS quote FROM events WHERE event_type = 'view')
SELECT a.k, trade_ts, price, quote_ts, quote FROM a JOIN b ON a.k = b.k AND quote_ts <= trade_ts AND quote_ts >= trade_ts - INTERVAL 6 HOUR""")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with their user's views of the six hours before, as a join of two streams."""
    of = lambda kind, x: _events(spark, d).where(F.col("event_type") == kind).select(F.col("user_id").alias("k"), "ts", F.col("value").alias(x))
    return pipeline.collected(pipeline.joined(of("purchase", "price"), of("view", "quote"), within="6 hours", late="1 hour"))


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@query("stream_bars", f"""WITH b AS (SELECT event_type AS k, date_trunc('hour', ts) AS t, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY 1, 2)
SELECT b.* FROM b, {_CLOSED} WHERE t + INTERVAL 1 HOUR <= mark""")
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars whose hour the watermark has closed."""
    return pipeline.collected(pipeline.windowed_bars(_events(spark, d), "1 hour", late="1 hour", key="event_type", x="value"))


@query("stream_sessions", f"""WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s),
  w AS (SELECT user_id AS k, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n, round(sum(value) + 1e-9, 6) + 0.0 AS total FROM g GROUP BY user_id, g) SELECT w.* FROM w, {_CLOSED} WHERE stop <= mark""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions that the watermark has closed."""
    return rounded(pipeline.collected(pipeline.sessions(_events(spark, d), "2 hours")))


@query("stream_rates", f"""WITH w AS (SELECT event_type AS k, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS t FROM events), c AS (SELECT k, t, count(*) AS n FROM w GROUP BY 1, 2)
SELECT c.* FROM c, {_CLOSED} WHERE t + INTERVAL 6 HOUR <= mark AND n > 10""")
def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events with more than ten in six hours, by the hour."""
    return pipeline.collected(pipeline.rate_alerts(_events(spark, d), 10, "6 hours", "1 hour", "event_type", "1 hour"))


@query("alert_life")
def alert_life(spark: SparkSession, d: str) -> DataFrame:
    """The alerts of one rule a kind of event: its value is in the top tenth of the range."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    checks = _events(spark, d).select(F.col("event_type").alias("rule"), "ts", (F.col("value") > 90).alias("firing"), "value", F.lit(None).cast("string").alias("action"))
    spark.conf.set(name, alerts.ROCKSDB)
    try:
        return pipeline.collected(alerts.alert_life(checks, cooldown=1800, expiry=7200, late="1 hour"))
    finally:
        spark.conf.set(name, before)
