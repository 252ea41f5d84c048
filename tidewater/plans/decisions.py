"""Predictions, alerts, patterns, text, sinks and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pct_change, ratio
from ..operators import alerts, ewm, market, patterns, predictions, text
from ..sinks import upsert as sinks
from ..sources import tables as tb
from ..sources.tables import by_time
from .indicators import B, full_sql, rs, windows
from .registry import W, query, r6, rounded

# predictions derived from bars: SMA(5) as prediction of the close three bars on, probability from the hour
_P = f"""p0 AS (SELECT k, t, close AS current, {full_sql('avg(close)', 'close', 5)} AS predicted, lead(close, 3) OVER ({W}) AS actual, 50.0 + (hour(t) * 7) % 50 AS probability FROM bars {windows(5)}),
  p1 AS (SELECT *, CASE WHEN predicted > current THEN 'UP' WHEN predicted < current THEN 'DOWN' ELSE 'FLAT' END AS pd, CASE WHEN actual > current THEN 'UP' WHEN actual < current THEN 'DOWN' ELSE 'FLAT' END AS ad FROM p0 WHERE predicted IS NOT NULL AND actual IS NOT NULL),
  p AS (SELECT *, pd = ad AS ok, least(greatest(1 - abs((predicted - actual) / nullif(actual, 0)), 0), 1) AS acc FROM p1)"""
PB = B + ", " + _P + " "


def predicted(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.columns import sma

    df = tb.hourly(spark, d).select("k", "t", F.col("close").alias("current"), sma("close", by_time(), 5).alias("predicted"), F.lead("close", 3).over(by_time()).alias("actual"), (F.lit(50.0) + (F.hour("t") * 7) % 50).alias("probability"))
    return predictions.evaluate(df.where("predicted IS NOT NULL AND actual IS NOT NULL"), "current", "predicted", "actual", "probability")


@query("prediction_eval", PB + f"SELECT k, t, pd AS predicted_direction, ad AS actual_direction, ok AS direction_correct, {rs('acc')} AS price_accuracy, {rs('0.5 * ok::INT + 0.3 * acc + 0.2 * CASE WHEN ok THEN probability / 100 ELSE 1 - probability / 100 END')} AS quality FROM p")
def prediction_eval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predicted(spark, d).select("k", "t", "predicted_direction", "actual_direction", "direction_correct", "price_accuracy", "quality"))


@query("accuracy_breakdown", PB + f"SELECT k, pd AS predicted_direction, count(*) AS n, {rs('avg(ok::INT)')} AS accuracy, count(*) FILTER (probability >= 70) AS n_sure, {rs('count(*) FILTER (probability >= 70 AND NOT ok) / nullif(count(*) FILTER (probability >= 70), 0)::DOUBLE')} AS false_positive FROM p GROUP BY 1, 2")
def accuracy_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions.accuracy_by(predicted(spark, d), ["k", "predicted_direction"], "direction_correct", "probability"))


@query("prob_buckets", PB + f"SELECT (floor(probability / 10) * 10)::BIGINT AS bucket, count(*) AS n, {rs('avg(ok::INT)')} AS accuracy FROM p GROUP BY 1")
def prob_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions.probability_buckets(predicted(spark, d), "direction_correct", "probability"))


@query("threshold_sweep", PB + f", s AS (SELECT th::INTEGER AS threshold, avg(ok::INT) FILTER (probability >= th) AS a, count(*) FILTER (probability >= th) / count(*)::DOUBLE AS c FROM p, unnest([60, 65, 70, 75, 80, 85]) AS u(th) GROUP BY 1) SELECT threshold, {rs('a')} AS accuracy, {rs('c')} AS coverage, {rs('coalesce(a * c, 0)')} AS value, row_number() OVER (ORDER BY coalesce(a * c, 0) DESC, threshold) = 1 AS best FROM s")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions.threshold_sweep(predicted(spark, d), "direction_correct", "probability", [60, 65, 70, 75, 80, 85]))


@query("error_by_hour", PB + f"SELECT hour(t)::INTEGER AS hour, (isodow(t) - 1)::INTEGER AS dow, {rs('avg(abs(predicted - actual))')} AS mean_error, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 3")
def error_by_hour(spark: SparkSession, d: str) -> DataFrame:
    found = predicted(spark, d).groupBy(F.hour("t").alias("hour"), F.weekday("t").alias("dow")).agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mean_error"), F.count("*").alias("n"))
    return rounded(found.where("n >= 3"))


@query("error_drift", PB + f", e AS (SELECT k, t, abs(predicted - actual) AS e FROM p) SELECT k, t, {rs(f'CASE WHEN count(e) OVER o = 20 THEN avg(e) OVER n / nullif(avg(e) OVER o, 0) - 1 END')} AS drift FROM e WINDOW n AS ({W} ROWS 19 PRECEDING), o AS ({W} ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)")
def error_drift(spark: SparkSession, d: str) -> DataFrame:
    df = predicted(spark, d).select("k", "t", F.abs(F.col("predicted") - F.col("actual")).alias("e"))
    return rounded(df.select("k", "t", predictions.error_drift("e", by_time(), 20).alias("drift")))


@query("inverse_mae_ensemble", PB + f", m AS (SELECT k, avg(abs(predicted - actual)) AS mae FROM p GROUP BY 1) SELECT t, {rs('sum(predicted / (mae + 1e-6)) / sum(1 / (mae + 1e-6))')} AS ensemble, count(*) AS members FROM p JOIN m USING (k) GROUP BY t")
def inverse_mae_ensemble(spark: SparkSession, d: str) -> DataFrame:
    df = predicted(spark, d)
    mae = df.groupBy("k").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    return rounded(predictions.inverse_error_ensemble(df.join(mae, "k"), ["t"], "predicted", "mae"))


@query("weighted_vote", PB + f", s AS (SELECT t, pd, sum(probability) AS w FROM p GROUP BY 1, 2), m AS (SELECT t, max(w) AS m, sum(w) AS tot FROM s GROUP BY 1) SELECT t, min(pd) AS vote, {rs('any_value(m / tot)')} AS confidence FROM s JOIN m USING (t) WHERE w = m GROUP BY t")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions.weighted_vote(predicted(spark, d), ["t"], "predicted_direction", "probability"))


# -- alerts -----------------------------------------------------------------------------
_RULES = [("click", ">", 70.0, True), ("view", "<", 20.0, True), ("error", ">=", 100.0, True), ("signup", "=", 50.0, True), ("purchase", ">", 10.0, False)]
_RULES_SQL = "rules(metric, operator, threshold, enabled) AS (VALUES " + ", ".join(f"('{m}', '{o}', {t}, {str(e).lower()})" for m, o, t, e in _RULES) + ")"
_FIRED = "f AS (SELECT k, t, close AS value, operator, threshold FROM bars JOIN rules ON k = metric WHERE enabled AND CASE operator WHEN '>' THEN close > threshold WHEN '<' THEN close < threshold WHEN '>=' THEN close >= threshold WHEN '=' THEN abs(close - threshold) < 1e-4 END)"


def fired(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "metric string, operator string, threshold double, enabled boolean")
    metrics = tb.hourly(spark, d).select(F.col("k").alias("metric"), "t", F.col("close").alias("value"))
    return alerts.evaluate(metrics, rules).select(F.col("metric").alias("k"), "t", "value", "operator", "threshold")


@query("alert_eval", B + f", {_RULES_SQL}, {_FIRED} SELECT * FROM f")
def alert_eval(spark: SparkSession, d: str) -> DataFrame:
    return fired(spark, d)


@query("alert_cooldown", "WITH RECURSIVE " + B.removeprefix("WITH ") + f", {_RULES_SQL}, {_FIRED}, c AS (SELECT k, min(t) AS t FROM f GROUP BY k UNION ALL SELECT c.k, (SELECT min(f.t) FROM f WHERE f.k = c.k AND f.t >= c.t + INTERVAL 6 HOUR) AS t FROM c WHERE c.t IS NOT NULL) SELECT k, t FROM c WHERE t IS NOT NULL")
def alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return ewm.cooldown(fired(spark, d), 6 * 3600).where("emitted").select("k", "t")


@query("alert_commands", """WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hello' ELSE '/set_alert ' || event_type || ' >= ' || (event_id % 100)::VARCHAR || '.5 "up ' || (event_id % 7)::VARCHAR || '"' END AS s, event_type FROM events)
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS indicator, CASE WHEN event_id % 3 <> 0 THEN '>=' END AS operator, CASE WHEN event_id % 3 <> 0 THEN event_id % 100 + 0.5::DOUBLE END AS threshold, CASE WHEN event_id % 3 <> 0 THEN 'up ' || (event_id % 7)::VARCHAR END AS message FROM c""")
def alert_commands(spark: SparkSession, d: str) -> DataFrame:
    command = F.concat(F.lit("/set_alert "), "event_type", F.lit(" >= "), F.col("event_id") % 100, F.lit('.5 "up '), F.col("event_id") % 7, F.lit('"'))
    df = tb.events(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, "hello").otherwise(command).alias("s"))
    return df.select("event_id", *[v.alias(n) for n, v in alerts.parse_command("s").items()])


@query("alert_gate", PB + ", a AS (SELECT k, avg(ok::INT) AS a FROM p GROUP BY 1) SELECT k, t, probability >= CASE WHEN a >= 0.8 THEN 60 WHEN a >= 0.6 THEN 70 WHEN a >= 0.4 THEN 80 ELSE 90 END AS passes, CASE WHEN a >= 0.8 THEN 'CRITICAL' WHEN a >= 0.6 THEN 'HIGH' WHEN a >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p JOIN a USING (k)")
def alert_gate(spark: SparkSession, d: str) -> DataFrame:
    df = predicted(spark, d)
    accuracy = df.groupBy("k").agg(F.avg(F.col("direction_correct").cast("int")).alias("a"))
    return df.join(accuracy, "k").select("k", "t", alerts.gate("a", "probability").alias("passes"), alerts.risk_level("a").alias("level"))


# -- patterns and text ------------------------------------------------------------------
@query("pattern_topk", B + f""", v AS (SELECT k, t, close, list(close) OVER w12 AS v, lead(close) OVER ({W}) AS outcome FROM bars {windows(12)}), n AS (SELECT k, arg_max(v, t) AS now, max(t) AS nt FROM v WHERE len(v) = 12 GROUP BY k),
  s AS (SELECT v.k, t, list_cosine_similarity(v, now) AS s, outcome FROM v JOIN n ON v.k = n.k WHERE t < nt AND len(v) = 12), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, t) AS rank FROM s WHERE s > 0.7) SELECT k, t, rank::INTEGER AS rank, {rs('s')} AS similarity, outcome FROM r WHERE rank <= 5""")
def pattern_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(patterns.similar_windows(tb.hourly(spark, d).select("k", "t", "close"), "close", by_time(), 12, 0.7, 5))


@query("vector_topk", f"WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, {rs('list_cosine_similarity(embedding::DOUBLE[], e)')} AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e) DESC, vec_id LIMIT 5")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = tb.table(spark, d, "embeddings")
    target = vectors.orderBy("vec_id").limit(1).select(F.transform("embedding", lambda x: x.cast("double")).alias("__target"))
    return rounded(patterns.nearest_vectors(vectors, target, "vec_id", "embedding", 5))


_LEX = lambda words: " + ".join(f"{w} * len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x = '{t}'))" for t, w in words.items())
_DOC_POS, _DOC_NEG = {"the": 1, "and": 2, "that": 3, "les": 1, "die": 1}, {"of": 2, "is": 1, "que": 1, "der": 2}


@query("sentiment_lexicon", f"WITH s AS (SELECT doc_id, {_LEX(_DOC_POS)} AS p, {_LEX(_DOC_NEG)} AS n FROM documents) SELECT doc_id, {rs('coalesce((p - n) / nullif(p + n, 0)::DOUBLE, 0)')} AS sentiment FROM s")
def sentiment_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.table(spark, d, "documents").select("doc_id", text.lexicon_score("text", _DOC_POS, _DOC_NEG).alias("sentiment")))


@query("keyword_topk", "WITH k AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in text.KEYWORDS) + "]) AS keyword) SELECT keyword, count(*) AS n FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 10")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return text.keyword_topk(tb.table(spark, d, "documents"), "text", 10)


@query("json_indicator_scores", f"SELECT event_type, {rs("sum((props->>'k')::DOUBLE)")} AS score, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def json_indicator_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.events(spark, d).where("value > 50").groupBy("event_type").agg(F.sum(text.json_number("props", ["missing.k", "k"])).alias("score"), F.count("*").alias("n")))


@query("json_flatten", "SELECT event_id, 'k' AS path, (props->>'k')::DOUBLE AS value FROM events")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return text.flatten_numbers(tb.events(spark, d), "props", ["event_id"])


@query("source_diversity", f"SELECT lang, count(DISTINCT source) AS sources, {rs('count(DISTINCT source) / 20.0')} AS diversity FROM documents GROUP BY 1")
def source_diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.table(spark, d, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), (F.countDistinct("source") / 20.0).alias("diversity")))


# -- sinks and sets ---------------------------------------------------------------------
@query("upsert_latest", "WITH b AS (SELECT user_id, event_type, ts, event_id, value FROM events) SELECT user_id, event_type, ts::TIMESTAMP AS ts, value FROM b QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.latest(tb.events(spark, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "ts", "value")


@query("upsert_retention", B + ", o AS (SELECT k, t, close AS v FROM bars WHERE day(t) <= 20), n AS (SELECT k, t, close + 1 AS v FROM bars WHERE day(t) >= 18), u AS (SELECT k, t, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (k, t)) SELECT k, t, v FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 500")
def upsert_retention(spark: SparkSession, d: str) -> DataFrame:
    bars = tb.hourly(spark, d)
    old = bars.where(F.dayofmonth("t") <= 20).select("k", "t", F.col("close").alias("v"))
    new = bars.where(F.dayofmonth("t") >= 18).select("k", "t", (F.col("close") + 1).alias("v"))
    return sinks.retained(sinks.upsert(old, new, ["k", "t"]), "k", "t", 500)


@query("usage_counter", "SELECT event_type, count(*) + 10 * (event_type IN ('click', 'view'))::INT AS usage_count FROM events GROUP BY 1")
def usage_counter(spark: SparkSession, d: str) -> DataFrame:
    old = spark.createDataFrame([("click", 10), ("view", 10)], "event_type string, usage_count long")
    return sinks.counted_upsert(old, tb.events(spark, d), ["event_type"])


@query("union_dedup", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(tb.table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("melt_features", B + "SELECT k, t, feature_name, value FROM (UNPIVOT (SELECT k, t, open, nullif(volume, 1) AS volume FROM bars) ON open, volume INTO NAME feature_name VALUE value)")
def melt_features(spark: SparkSession, d: str) -> DataFrame:
    return sinks.melt(tb.hourly(spark, d).select("k", "t", "open", F.nullif("volume", F.lit(1.0)).alias("volume")), ["k", "t"], ["open", "volume"])


@query("left_join_rollup", f"SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment, count(o_orderkey) AS n, {rs('coalesce(sum(o_totalprice), 0)')} AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_rollup(spark: SparkSession, d: str) -> DataFrame:
    joined = tb.table(spark, d, "customer").join(tb.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rounded(joined.groupBy("c_custkey").agg(F.first("c_mktsegment").alias("c_mktsegment"), F.count("o_orderkey").alias("n"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total")))


@query("conditional_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return tb.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.countDistinct("o_custkey").alias("customers"))


@query("top_commands", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, user_id LIMIT 5")
def top_commands(spark: SparkSession, d: str) -> DataFrame:
    return tb.events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "user_id").limit(5)


@query("missing_report", "SELECT count(*) AS n, count(*) - count(value) AS missing, count(*) - count(DISTINCT event_id) AS duplicates, count(*) FILTER (value = 0) AS zeros FROM events")
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    return tb.events(spark, d).agg(F.count("*").alias("n"), (F.count("*") - F.count("value")).alias("missing"), (F.count("*") - F.countDistinct("event_id")).alias("duplicates"), F.count_if(F.col("value") == 0).alias("zeros"))


# -- folds ------------------------------------------------------------------------------
@query("walk_forward_folds", B + """, n AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM bars), f AS (SELECT k, t, i, unnest(range(greatest((i - 254 + 49) // 50, 0)::BIGINT, least(i // 50, (n - 255) // 50)::BIGINT + 1)) AS fold FROM n WHERE n >= 255),
  j AS (SELECT k, t, fold, i - fold * 50 AS j FROM f) SELECT k, fold::INTEGER AS fold, CASE WHEN j < 200 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(t) AS start, max(t) AS stop FROM j WHERE j < 200 OR j >= 205 GROUP BY 1, 2, 3""")
def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions.walk_forward(tb.hourly(spark, d).select("k", "t"), by_time(), 200, 50, gap=5)
    return rows.groupBy("k", "fold", "part").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("stop"))


@query("window_slices", B + f", n AS (SELECT k, close, row_number() OVER ({W}) - 1 AS i FROM bars), s AS (SELECT k, close, unnest(range(greatest((i - 47 + 11) // 12, 0)::BIGINT, (i // 12)::BIGINT + 1)) AS w FROM n) SELECT k, w AS window_id, count(*) AS n, {rs('avg(close)')} AS mean FROM s GROUP BY 1, 2")
def window_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions.sliding_windows(tb.hourly(spark, d).select("k", "t", "close"), by_time(), 48, 12)
    return rounded(rows.groupBy("k", F.col("window").alias("window_id")).agg(F.count("*").alias("n"), F.avg("close").alias("mean")))


@query("purged_groups", B + f""", g AS (SELECT k, t, sum(CASE WHEN p IS NULL OR epoch(t) - epoch(p) > 3600 THEN 1 ELSE 0 END) OVER ({W}) AS g FROM (SELECT k, t, lag(t) OVER ({W}) AS p FROM bars)), e AS (SELECT k, min(t) AS a, max(t) AS b FROM g WHERE g = 3 GROUP BY k)
SELECT k, CASE WHEN g = 3 THEN 'test' WHEN t >= a - INTERVAL 12 HOUR AND t <= b + INTERVAL 12 HOUR THEN 'purged' ELSE 'train' END AS part, count(*) AS n FROM g LEFT JOIN e USING (k) GROUP BY 1, 2""")
def purged_groups(spark: SparkSession, d: str) -> DataFrame:
    return predictions.purged_groups(tb.hourly(spark, d).select("k", "t"), by_time(), "t", 1, 3, 12).groupBy("k", "part").agg(F.count("*").alias("n"))


@query("running_pattern_error", PB + f"SELECT pd || '|' || hour(t)::VARCHAR AS pattern, {rs('avg(abs(predicted - actual))')} AS mean_error, count(*) AS n FROM p GROUP BY 1")
def running_pattern_error(spark: SparkSession, d: str) -> DataFrame:
    df = predicted(spark, d).withColumn("pattern", F.concat_ws("|", "predicted_direction", F.hour("t").cast("string")))
    return rounded(df.groupBy("pattern").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mean_error"), F.count("*").alias("n")))


@query("shock_analysis", B + f", r AS (SELECT k, t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars) SELECT k, count(*) FILTER (abs(r) > 0.05) AS shocks, {rs('max(abs(r))')} AS largest, {rs('avg(abs(r)) FILTER (abs(r) > 0.05)')} AS mean_shock FROM r GROUP BY k")
def shock_analysis(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", pct_change("close", by_time()).alias("r"))
    big = F.abs("r") > 0.05
    return rounded(df.groupBy("k").agg(F.count_if(big).alias("shocks"), F.max(F.abs("r")).alias("largest"), F.avg(F.when(big, F.abs("r"))).alias("mean_shock")))


@query("cross_features", B + f"SELECT k, t, {rs('close * volume')} AS close_x_volume, {rs('close / nullif(open, 0)')} AS close_div_open, {rs('high - low')} AS high_minus_low FROM bars")
def cross_features(spark: SparkSession, d: str) -> DataFrame:
    return tb.hourly(spark, d).select("k", "t", r6(F.col("close") * F.col("volume")).alias("close_x_volume"), r6(ratio("close", "open")).alias("close_div_open"), r6(F.col("high") - F.col("low")).alias("high_minus_low"))


@query("interval_join", """WITH b AS (SELECT c_custkey AS k, TIMESTAMP '1992-01-01' + INTERVAL 1 DAY * (c_custkey % 2000) AS a, TIMESTAMP '1992-01-01' + INTERVAL 1 DAY * (c_custkey % 2000 + 300) AS z FROM customer)
SELECT o_orderkey, o_custkey AS k FROM orders JOIN b ON o_custkey = k WHERE o_orderdate >= a AND o_orderdate < z""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.asof import interval_join as join

    day = lambda n: F.lit("1992-01-01").cast("timestamp") + F.make_dt_interval(days=n.cast("int"))
    spans = tb.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), day(F.col("c_custkey") % 2000).alias("a"), day(F.col("c_custkey") % 2000 + 300).alias("z"))
    points = tb.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return join(points, spans, ["k"], "at", "a", "z", bucket_seconds=30 * 86_400).select("o_orderkey", "k")


@query("book_snapshot", f"""WITH l AS (SELECT l_suppkey, l_extendedprice / l_quantity AS p, l_quantity AS q, l_returnflag = 'N' AS ask FROM lineitem), b AS (SELECT l_suppkey, max(p) FILTER (NOT ask) AS bid, min(p) FILTER (ask) AS best_ask FROM l GROUP BY 1) SELECT l_suppkey, {rs('best_ask - bid')} AS spread, {rs('(best_ask + bid) / 2')} AS mid FROM b WHERE bid IS NOT NULL AND best_ask IS NOT NULL""")
def book_snapshot(spark: SparkSession, d: str) -> DataFrame:
    trades = tb.trades(spark, d)
    level = F.struct(F.col("price"), F.col("size"))
    bids = F.reverse(F.array_sort(F.collect_list(F.when(F.col("side") != "buy", level))))
    asks = F.array_sort(F.collect_list(F.when(F.col("side") == "buy", level)))
    books = trades.groupBy("l_suppkey").agg(bids.alias("bids"), asks.alias("asks")).where("size(bids) > 0 AND size(asks) > 0")
    cols = market.book_features()
    return rounded(books.select("l_suppkey", cols["spread"].alias("spread"), cols["mid"].alias("mid")))
