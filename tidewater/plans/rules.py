"""Filters, classes, drift, holdouts, watches and caches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite, flag, pct_change, ratio, rolling
from ..operators import alerts, correlation, outliers, predictions, regimes, text
from ..sinks import upsert as sinks
from ..sources import tables as tb
from ..sources.tables import by_time
from .decisions import PB, predicted
from .indicators import B, full_sql, rs, windows
from .regimes import RET, returns
from .registry import W, query, r6, rounded


@query("tail_clip", f"WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY 1) SELECT event_id, {rs('least(greatest(value, a - 0.05 * (b - a)), b + 0.05 * (b - a))')} AS value FROM events JOIN q USING (event_type)")
def tail_clip(spark: SparkSession, d: str) -> DataFrame:
    """Values held near their far quantiles."""
    return rounded(outliers.clip_beyond_tails(tb.events(spark, d), "value", ["event_type"], k=0.05).select("event_id", "value"))


@query("volatility_persistence", B + f""", {RET}, v AS (SELECT k, t, r, {full_sql('stddev_pop(r)', 'r', 5)} AS v FROM (SELECT * FROM r WHERE r IS NOT NULL) {windows(5)}), l AS (SELECT k, r, v, lag(v) OVER ({W}) AS l FROM v), s AS (SELECT k, stddev_pop(r) AS s, count(*) AS n, corr(v, l) AS c FROM l GROUP BY 1)
SELECT k, {rs('s')} AS volatility, CASE WHEN s < 0.02 THEN 'very_low' WHEN s < 0.05 THEN 'low' WHEN s < 0.10 THEN 'medium' WHEN s < 0.20 THEN 'high' ELSE 'extreme' END AS class, {rs('CASE WHEN n < 20 OR c IS NULL OR isnan(c) THEN 0.5 ELSE least(greatest((c + 1) / 2, 0), 1) END')} AS persistence FROM s""")
def volatility_persistence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regimes.volatility_persistence(returns(spark, d), "r", by_time()))


@query("drift", B + f""", m AS (SELECT k, t, {', '.join(f"CASE WHEN count(*) OVER ({W} ROWS 49 PRECEDING) = 50 THEN abs(avg({x}) OVER ({W} ROWS 24 PRECEDING) - avg({x}) OVER ({W} ROWS BETWEEN 49 PRECEDING AND 25 PRECEDING)) END AS {x}" for x in ('close', 'volume'))} FROM bars)
SELECT k, t, {rs('close')} AS close_drift, {rs('volume')} AS volume_drift, {rs('(close + volume) / 2')} AS combined_drift, coalesce((close + volume) / 2 > 20, false) AS drifted FROM m""")
def drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions.drift(tb.hourly(spark, d).select("k", "t", "close", "volume"), ["close", "volume"], by_time(), 50, 20.0).drop("close", "volume"))


@query("holdout", B + f""", i AS (SELECT k, t, close, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY k) AS n FROM bars) SELECT k, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part, count(*) AS n, min(t) AS start, max(t) AS stop FROM i GROUP BY 1, 2""")
def holdout(spark: SparkSession, d: str) -> DataFrame:
    df = predictions.holdout(tb.hourly(spark, d).select("k", "t"), by_time())
    return df.groupBy("k", "part").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("stop"))


@query("recent_accuracy", PB + f"SELECT k AS model, {rs('avg(acc)')} AS price_accuracy, {rs('avg(ok::INT)')} AS accuracy, count(*) AS n FROM p WHERE t >= TIMESTAMP '2024-01-15' GROUP BY 1 HAVING count(*) >= 5")
def recent_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Mean accuracies by model since a time, where there are five predictions and more."""
    rows = predicted(spark, d).where(F.col("t") >= F.lit(dt.datetime(2024, 1, 15)))
    found = rows.groupBy(F.col("k").alias("model")).agg(F.avg("price_accuracy").alias("price_accuracy"), F.avg(F.col("direction_correct").cast("int")).alias("accuracy"), F.count("*").alias("n"))
    return rounded(found.where("n >= 5"))


@query("matching_rows", "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'tion') AND lang = 'en' AND doc_id >= 20")
def matching_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a text they contain, a language and a least id."""
    return text.matching(tb.table(spark, d, "documents"), {"text": "TION", "source": None}, {"lang": "en"}, ("doc_id", 20)).select("doc_id", "lang", "source")


@query("latest_within", "WITH m AS (SELECT max(ts) AS m FROM events), l AS (SELECT user_id, max((ts, event_id, event_type, value)) AS l FROM events GROUP BY 1) SELECT user_id, l[1] AS ts, l[2] AS event_id, l[3] AS event_type, l[4] AS value FROM l, m WHERE floor(epoch(l[1])) >= floor(epoch(m)) - 7200")
def latest_within(spark: SparkSession, d: str) -> DataFrame:
    """Users' latest events, as long as they are no older than two hours at the newest event of all."""
    ev = tb.events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    newest = ev.agg(F.max("ts")).first()[0]
    return sinks.latest_within(ev, ["user_id"], "ts", newest, 7200)


@query("watch_requests", """WITH m AS (SELECT user_id, event_id, floor(value)::INTEGER AS v FROM events), w AS (SELECT event_id, v, event_id % 3 AS kind FROM m) SELECT event_id, CASE WHEN kind = 2 THEN NULL ELSE 'BTC' END AS indicator, CASE kind WHEN 0 THEN v * 10000.0::DOUBLE WHEN 1 THEN v::DOUBLE ELSE NULL END AS threshold, CASE kind WHEN 0 THEN '>=' WHEN 1 THEN '<' ELSE NULL END AS operator FROM w""")
def watch_requests(spark: SparkSession, d: str) -> DataFrame:
    """Free-form watch requests made of events, parsed."""
    v = F.floor("value").cast("string")
    kind = F.col("event_id") % 3
    ask = F.when(kind == 0, F.concat(F.lit("BTC 가격이 "), v, F.lit("만 이상"))).when(kind == 1, F.concat(F.lit("BTC "), v, F.lit(" 미만이면"))).otherwise("?")
    rows = tb.events(spark, d).select("event_id", ask.alias("ask"))
    return rows.select("event_id", *[p.alias(n) for n, p in alerts.parse_watch("ask").items()])


@query("flags", B + f""", {RET} SELECT k, t, {rs('stddev_pop(r) OVER (' + W + ' ROWS 9 PRECEDING)')} AS deviation, CASE WHEN r > 0 THEN 1.0::DOUBLE WHEN r IS NULL THEN NULL ELSE 0.0 END AS up, {rs('close / nullif(r, 0)')} AS per_return,
  CASE WHEN abs(r) >= 0.8 THEN 'CRITICAL' WHEN abs(r) >= 0.6 THEN 'HIGH' WHEN abs(r) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE k WHEN 'click' THEN close > 50 WHEN 'view' THEN abs(close - 50) < 1e-6 ELSE close <= 50 END AS fired FROM r QUALIFY count(r) OVER ({W} ROWS 9 PRECEDING) = 10""")
def flags(spark: SparkSession, d: str) -> DataFrame:
    """Population deviations, flags, finite ratios, levels and comparisons whose operator is data."""
    df = returns(spark, d)
    op = F.when(F.col("k") == "click", ">").when(F.col("k") == "view", "=").otherwise("<=")
    df = df.select("k", "t", rolling("std0", "r", by_time(), 10).alias("deviation"), flag(F.col("r") > 0).alias("up"), finite(ratio("close", "r")).alias("per_return"), alerts.risk_level(F.abs("r")).alias("level"), alerts.compare("close", op, F.lit(50.0), 1e-6).alias("fired"))
    return rounded(df.where("deviation IS NOT NULL"))


@query("due_predictions", B + "SELECT k, t, close, (1 + hour(t) % 6)::INTEGER AS horizon FROM bars WHERE t + (1 + hour(t) % 6) * INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:00:00'")
def due_predictions(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", "t", "close", (1 + F.hour("t") % 6).cast("int").alias("horizon"))
    return predictions.due(df, F.lit(dt.datetime(2024, 1, 20, 12)))


@query("inlier_rows", B + f""", q AS (SELECT {', '.join(f'quantile_cont({x}, 0.25) AS {x}1, quantile_cont({x}, 0.75) AS {x}3' for x in ('close', 'volume'))} FROM bars) SELECT k, t, close, volume FROM bars, q WHERE {' AND '.join(f'{x} BETWEEN {x}1 - 1.5 * ({x}3 - {x}1) AND {x}3 + 1.5 * ({x}3 - {x}1)' for x in ('close', 'volume'))}""")
def inlier_rows(spark: SparkSession, d: str) -> DataFrame:
    """Bars of which no column is beyond the quartiles by more than one and a half of their gaps."""
    return outliers.drop_iqr_rows(tb.hourly(spark, d).select("k", "t", "close", "volume"), ["close", "volume"], 1.5)


@query("useful_columns", "SELECT unnest(['value', 'user_id']) AS name")
def useful_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of events with values and spread, without copies of others."""
    ev = tb.events(spark, d).select("value", "user_id", F.col("value").alias("copy"), F.lit(1.0).alias("constant"), F.when(F.col("event_id") < 0, 1.0).alias("empty"))
    return spark.createDataFrame([(n,) for n in correlation.useful_columns(ev, ev.columns)], "name string")
