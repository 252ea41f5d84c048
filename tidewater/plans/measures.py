"""Entropies, normality, curvature, filters, combined estimates, drawdowns, weighted predictions and round trips of the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import gaussian_filter, median_filter, pct_change, ratio, rolling_central_moment, rows
from ..operators import neighbours, predictions, risk, robust, significance
from ..session import shared_dir
from ..sinks import upsert as sinks
from ..sources import files
from ..sources import tables as tb
from ..sources.tables import by_time
from ..streaming import parse, pipeline
from .indicators import B, rs, windows
from .inference import _delays
from .regimes import RET, returns
from .registry import W, chi2_p_sql, query, r6, rounded


def _phi(m: int) -> str:
    """Mean log shares and pairs of m-value vectors, as phi{m}."""
    gaps = ", ".join(f"abs(a.x{j} - b.x{j})" for j in range(m))
    v = _delays(m).replace("dl AS", f"dl{m} AS").replace("v AS", f"v{m} AS").replace("FROM dl ", f"FROM dl{m} ")
    return f"""{v}, c{m} AS (SELECT a.k, a.i, a.n, count(*) FILTER (greatest({gaps}) < 0.2 OR a.i = b.i) AS c FROM v{m} a JOIN v{m} b ON a.k = b.k GROUP BY 1, 2, 3),
  phi{m} AS (SELECT k, avg(ln(c / n)) AS phi, sum(c - 1) / 2 AS pairs FROM c{m} GROUP BY 1)"""


@query("pair_entropies", B + f""", {_phi(2)}, {_phi(3)} SELECT phi2.k, {rs('phi2.phi - phi3.phi')} AS approximate, {rs('-ln(nullif(phi3.pairs, 0) / nullif(phi2.pairs, 0))')} AS sample FROM phi2 JOIN phi3 USING (k)""")
def pair_entropies(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.pair_entropies(tb.hourly(spark, d), "close", by_time()))


_COARSE = "bars0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, close AS x FROM bars)"


def _scale(s: int) -> str:
    inner = f"WITH bars AS (SELECT k, i // {s} AS t, avg(x) AS close FROM bars0 GROUP BY 1, 2 HAVING count(*) = {s}), {_phi(2)}, {_phi(3)}"
    return f"SELECT k, {s}::INTEGER AS scale, {rs('-ln(nullif(b.pairs, 0) / nullif(a.pairs, 0))')} AS sample FROM ({inner} SELECT phi2.k, phi2.pairs FROM phi2) a JOIN ({inner} SELECT phi3.k, phi3.pairs FROM phi3) b USING (k)"


@query("multiscale_entropy", B + f", {_COARSE} " + " UNION ALL ".join(_scale(s) for s in (1, 2, 4)))
def multiscale_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbours.multiscale_entropy(tb.hourly(spark, d), "close", by_time(), [1, 2, 4]))


@query("normality", B + f""", {RET}, s AS (SELECT k, count(r)::DOUBLE AS n, avg(r) AS m FROM r WHERE r IS NOT NULL GROUP BY 1), q AS (SELECT k, s.n, avg((r - m) ** 2) AS m2, avg((r - m) ** 3) AS m3, avg((r - m) ** 4) AS m4 FROM r JOIN s USING (k) WHERE r IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT k, n, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 - 3 AS g2 FROM q), a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n ** 2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
    (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 * (n ** 2 - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM g),
  z AS (SELECT *, asinh(y * sqrt((w2 - 1) / 2)) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / b * (2 / b + sqrt(1 + 4 / b ** 2)) AS a FROM a), f AS (SELECT k, n, n / 6 * (g1 ** 2 + g2 ** 2 / 4) AS jb, z1 ** 2 + (((1 - 2 / (9 * a)) - sign((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) * abs((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) ** (1.0 / 3)) / sqrt(2 / (9 * a))) ** 2 AS k2 FROM z)
SELECT k, n::BIGINT AS n, {rs('jb')} AS jarque_bera, {rs('exp(-jb / 2)')} AS jarque_bera_p, {rs('k2')} AS dagostino, {rs('exp(-k2 / 2)')} AS dagostino_p FROM f""")
def normality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.normality(returns(spark, d), "r", ["k"]))


@query("curvature", B + f""", y AS (SELECT k, t, close / max(abs(close)) OVER (PARTITION BY k) AS y FROM bars), l AS (SELECT k, y, lag(y) OVER ({W}) AS l FROM y), p AS (SELECT * FROM l WHERE l IS NOT NULL), b AS (SELECT k, sum(y * l) / sum(l * l) AS b FROM p GROUP BY 1),
  e AS (SELECT k, l, (y - b * l) ** 2 AS e FROM p JOIN b USING (k)), s AS (SELECT k, count(*) AS n, sum(l ** 2) AS a, sum(l ** 3) AS b, sum(l ** 4) AS c, sum(l ** 5) AS d, sum(l ** 6) AS f, sum(e * l) AS u, sum(e * l ** 2) AS v, sum(e * l ** 3) AS w, sum(e * e) AS ee, var_pop(e) * count(*) AS tt FROM e GROUP BY 1),
  q AS (SELECT *, a * (c * f - d * d) - b * (b * f - d * c) + c * (b * d - c * c) AS det FROM s),
  x AS (SELECT *, (u * (c * f - d * d) - b * (v * f - d * w) + c * (v * d - c * w)) / det AS x1, (a * (v * f - d * w) - u * (b * f - d * c) + c * (b * w - v * c)) / det AS x2, (a * (c * w - v * d) - b * (b * w - v * c) + u * (b * d - c * c)) / det AS x3 FROM q),
  m AS (SELECT k, n, n * (1 - (ee - x1 * u - x2 * v - x3 * w) / tt) AS lm FROM x) SELECT k, n, round(lm, 3) + 0.0 AS lm, round({chi2_p_sql('greatest(lm, 0)', 3)}, 3) + 0.0 AS p FROM m""")
def curvature(spark: SparkSession, d: str) -> DataFrame:
    s = significance.curvature(tb.hourly(spark, d), "close", by_time(), ["k"])
    return s.select("k", "n", *[(F.round(n, 3) + 0.0).alias(n) for n in ("lm", "p")])


@query("conditional_entropy", B + f""", m AS (SELECT k, close, volume, min(close) OVER p AS a, max(close) OVER p AS b, min(volume) OVER p AS c, max(volume) OVER p AS e FROM bars WINDOW p AS (PARTITION BY k)), z AS (SELECT k, coalesce(least(floor((close - a) * 20 / nullif(b - a, 0)), 19), 0) AS x, coalesce(least(floor((volume - c) * 20 / nullif(e - c, 0)), 19), 0) AS y FROM m),
  n AS (SELECT k, x, y, count(*) AS c FROM z GROUP BY ALL), h AS (SELECT k, -sum(c * log2(c / s)) / sum(c) AS hxy FROM (SELECT k, c, sum(c) OVER (PARTITION BY k) AS s FROM n) GROUP BY 1), g AS (SELECT k, -sum(c * log2(c / s)) / sum(c) AS hx FROM (SELECT k, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY k) AS s FROM n GROUP BY k, x) GROUP BY 1)
SELECT k, {rs('hxy - hx')} AS conditional_entropy FROM h JOIN g USING (k)""")
def conditional_entropy(spark: SparkSession, d: str) -> DataFrame:
    """What is open about the volume when the price is known."""
    return rounded(significance.conditional_entropy(tb.hourly(spark, d), "close", "volume", 20, ["k"]))


@query("central_moments", B + f""", b AS (SELECT k, t, close / 1000 AS x FROM bars), m AS (SELECT k, t, list(x) OVER w24 AS v, avg(x) OVER w24 AS m FROM b {windows(24)}) SELECT k, t, {', '.join(f"{rs(f'CASE WHEN len(v) = 24 THEN list_avg(list_transform(v, lambda z: (z - m) ** {p})) END')} AS moment_{p}" for p in (3, 4))} FROM m""")
def central_moments(spark: SparkSession, d: str) -> DataFrame:
    """Of the closes in thousands."""
    o = by_time()
    return rounded(tb.hourly(spark, d).select("k", "t", *[rolling_central_moment(F.col("close") / 1000, o, 24, p).alias(f"moment_{p}") for p in (3, 4)]))


_TAP = "exp(-0.5 * j * j)"


@query("smoothing_filters", B + f""", v AS (SELECT k, list(close ORDER BY t) AS v FROM bars GROUP BY 1), i AS (SELECT k, t, row_number() OVER ({W}) - 1 AS i FROM bars),
  p AS (SELECT k, t, i, len(v) AS n, v FROM i JOIN v USING (k)), e AS (SELECT k, t, list_transform(range(-4, 5), lambda j: v[1 + CASE WHEN (i + j + 2 * n) % (2 * n) < n THEN (i + j + 2 * n) % (2 * n) ELSE 2 * n - 1 - (i + j + 2 * n) % (2 * n) END]) AS e FROM p),
  f AS (SELECT k, t, list_sort(e[3:7])[3] AS m, list_sum(list_transform(range(-4, 5), lambda j: e[j + 5] * {_TAP})) / list_sum(list_transform(range(-4, 5), lambda j: {_TAP})) AS g FROM e)
SELECT k, t, {rs('m')} AS median_5, {rs('g')} AS gaussian, {rs('(m + g) / 2')} AS combined FROM f""")
def smoothing_filters(spark: SparkSession, d: str) -> DataFrame:
    """Medians of five, a bell of one row, and the mean of both, with mirrored ends."""
    o = by_time()
    df = tb.hourly(spark, d).select("k", "t", median_filter("close", o, 5).alias("median_5"), gaussian_filter("close", o).alias("gaussian"))
    return rounded(df.withColumn("combined", (F.col("median_5") + F.col("gaussian")) / 2))


@query("weighted_trim", f"""WITH r AS (SELECT event_type, value AS x, (user_id % 7 + 1)::DOUBLE AS w FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x, w) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, {rs('sum(x * w) / sum(w)')} AS trimmed_mean FROM i WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY 1""")
def weighted_trim(spark: SparkSession, d: str) -> DataFrame:
    ev = tb.events(spark, d).withColumn("w", (F.col("user_id") % 7 + 1).cast("double"))
    return rounded(robust.weighted_trimmed_mean(ev, "value", "w", ["event_type"]))


@query("drawdown_report", B + f""", {RET}, g AS (SELECT k, t, exp(sum(ln(1 + coalesce(r, 0))) OVER ({W})) AS w FROM r), p AS (SELECT k, t, w, greatest(max(w) OVER ({W}), 1.0) AS p FROM g), d AS (SELECT *, CASE WHEN w < p * (1 - 1e-12) THEN w / p - 1 ELSE 0 END AS d FROM p),
  b AS (SELECT *, CASE WHEN d < 0 AND coalesce(lag(d) OVER ({W}), 0) >= 0 THEN 1 ELSE 0 END AS b, last_value(CASE WHEN d >= 0 THEN t END IGNORE NULLS) OVER ({W}) AS top FROM d), x AS (SELECT k, t AS trough, d AS md, top, p AS peak FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, t) = 1),
  s AS (SELECT k, count(*) AS n, sum(b) AS periods, avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END) AS u, count(*) FILTER (d < 0) AS c FROM b GROUP BY 1), y AS (SELECT b.k, min(b.t) AS recovery FROM b JOIN x ON b.k = x.k AND b.t > trough AND b.w >= peak * (1 - 1e-12) GROUP BY 1)
SELECT k, n, {rs('md')} AS max_drawdown, top AS start, trough, recovery, periods::BIGINT AS periods, {rs('periods / n')} AS frequency, {rs('u')} AS underwater, {rs('c / nullif(periods, 0)')} AS mean_length FROM s JOIN x USING (k) LEFT JOIN y USING (k)""")
def drawdown_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.drawdown_report(returns(spark, d), "r", by_time()))


@query("reward_ratios", B + f""", {RET}, q AS (SELECT k, quantile_cont(r, 0.05) AS v, quantile_cont(r, 0.95) AS u, avg(r) * 252 AS a FROM r GROUP BY 1), l AS (SELECT k, r, lag(r) OVER ({W}) AS l FROM r), t AS (SELECT l.k, count(*) FILTER (l < v AND r < v) / nullif(count(*) FILTER (l < v), 0) AS lo, count(*) FILTER (l > u AND r > u) / nullif(count(*) FILTER (l > u), 0) AS hi FROM l JOIN q USING (k) WHERE r IS NOT NULL AND l IS NOT NULL GROUP BY 1)
SELECT k, {rs('a')} AS treynor, {rs('a / nullif(abs(v) * sqrt(252), 0)')} AS return_to_var, {rs('lo')} AS lower, {rs('hi')} AS upper FROM q JOIN t USING (k)""")
def reward_ratios(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d)
    return rounded(risk.reward_ratios(r, "r", ["k"]).join(risk.tail_dependence(r, "r", by_time()), "k"))


#: Indicators' thresholds, correlations with the price, impacts and lags in hours; and the methods' weights.
RULES = {"momentum": (0.05, 0.6, 0.02, 6.0), "volume": (1.2, 0.4, 0.03, 2.0), "reversal": (0.1, -0.3, 0.05, 12.0)}
METHODS = {"indicator": 0.4, "pattern": 0.3}
_RULE = lambda j: "CASE name " + " ".join(f"WHEN '{n}' THEN {v[j]}" for n, v in RULES.items()) + " END"


@query("weighted_prediction", B + f""", b AS (SELECT k, t, close / nullif(lag(close, 6) OVER ({W}), 0) - 1 AS momentum, volume / nullif(avg(volume) OVER ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) AS volume, close / nullif(open, 0) - 1 AS reversal FROM bars), l AS (UNPIVOT b ON momentum, volume, reversal INTO NAME name VALUE value),
  w AS (SELECT k, t, {_RULE(0)} AS th, {_RULE(1)} AS c, {_RULE(2)} AS im, {_RULE(3)} AS lag, value FROM l), h AS (SELECT k, t, abs(c) * 100 AS w, c * im * value / th AS ch, lag FROM w WHERE abs(value) > th), s AS (SELECT k, t, sum(w) AS w, sum(ch * w) AS c, sum(lag * w) AS l, count(*) AS n FROM h GROUP BY 1, 2),
  i AS (SELECT b.k, b.t, coalesce(c / w, 0) AS change, floor(coalesce(l / w, 0)) AS timeframe, least(coalesce(w / n, 0), 100) AS confidence FROM b LEFT JOIN s USING (k, t)), u AS (SELECT k, t, 0.4 * confidence / 100 AS w, change, timeframe, confidence FROM i WHERE confidence > 0 UNION ALL SELECT k, t, 0.3 * 0.5, CASE WHEN momentum > 0 THEN 0.01 ELSE -0.01 END, 24, 50.0 FROM b WHERE abs(momentum) > 0.2),
  e AS (SELECT k, t, sum(w) AS w, sum(change * w) AS c, sum(timeframe * w) AS f, sum(confidence * w) AS o FROM u GROUP BY 1, 2) SELECT b.k, b.t, {rs('coalesce(c / w, 0)')} AS predicted_change, floor(coalesce(f / w, 6) + 1e-9)::INTEGER AS timeframe_hours, {rs('coalesce(o / w, 0)')} AS confidence FROM b LEFT JOIN e USING (k, t)""")
def weighted_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Indicators beyond their thresholds and a move's pattern, put together by weight and confidence."""
    o = by_time()
    b = tb.hourly(spark, d).select("k", "t", pct_change("close", o, 6).alias("momentum"), ratio("volume", F.avg("volume").over(rows(o, 24, 1))).alias("volume"), (ratio("close", "open") - 1).alias("reversal"))
    long = b.unpivot(["k", "t"], ["momentum", "volume", "reversal"], "name", "value")
    one = predictions.indicator_prediction(long, RULES, ["k", "t"]).select("k", "t", F.lit("indicator").alias("method"), "change", F.col("timeframe").cast("double").alias("timeframe"), "confidence")
    big = F.abs("momentum") > 0.2
    two = b.select("k", "t", F.lit("pattern").alias("method"), F.when(F.col("momentum") > 0, 0.01).otherwise(-0.01).alias("change"), F.lit(24.0).alias("timeframe"), F.when(big, 50.0).otherwise(0.0).alias("confidence"))
    return rounded(predictions.confidence_ensemble(one.unionByName(two), METHODS, ["k", "t"]))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidewater-files/{uuid.uuid4().hex}"


@query("csv_round_trip", f"SELECT event_type AS category, date_trunc('hour', ts) AS ts, {rs('sum(value)')} AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Hourly sums written as CSV by category and read back through the pruned category scan."""
    root = _folder(spark)
    hours = tb.events(spark, d).groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(r6(F.sum("value")).alias("value"))
    for kind in ("click", "error", "purchase", "signup", "view"):
        sinks.write_csv(hours.where(F.col("event_type") == kind).select("ts", "value"), f"{root}/{kind}")
    return files.indicator_files(spark, root, suffix=".csv").where("category <> 'error'").select("category", "ts", "value")


@query("parsed_ticks", "SELECT event_id, 'BTC' AS symbol, ts::TIMESTAMP AS ts, (10000 + 100 * value) AS price, value AS volume, value < 0 OR value > 1900 AS failed FROM events")
def parsed_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events as exchange messages, parsed and validated."""
    ev = tb.events(spark, d)
    micros = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    payload = F.to_json(F.struct(F.lit("BTC").alias("product_id"), (10000 + 100 * F.col("value")).cast("string").alias("price"), F.col("value").cast("string").alias("volume_24h"), micros.alias("time"), F.col("event_id").cast("string").alias("id")))
    raw = ev.select(F.lit("coinbase").alias("source"), F.lit("coinbase_ticker").alias("parser"), payload.alias("payload"), F.col("ts").alias("ingest_ts"), "event_id")
    both = parse.parse(raw.withColumn("source", F.col("event_id").cast("string"))).withColumn("errors", parse.errors())
    return both.select(F.col("source").cast("long").alias("event_id"), "symbol", "ts", "price", "volume", (F.size("errors") > 0).alias("failed"))


@query("stream_quality", f"SELECT event_type AS source, count(*) AS n, max(ts) AS newest, 1.0::DOUBLE AS completeness, {rs('stddev_pop(value) / nullif(avg(value), 0)')} AS variation, {rs('avg(event_id % 50)')} AS latency_ms FROM events GROUP BY 1")
def stream_quality(spark: SparkSession, d: str) -> DataFrame:
    ticks = tb.events(spark, d).select(F.col("event_type").alias("source"), "ts", F.col("value").alias("price"), (F.col("event_id") % 50).cast("double").alias("latency_ms"))
    return rounded(pipeline.quality_metrics(ticks))
