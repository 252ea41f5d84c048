"""Feature sets, tests of dependence, smoothing, adaptive folds and tail risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import feature_sets, fill, predictions, risk, significance
from ..sources import tables as tb
from ..sources.tables import by_time
from .indicators import B, full_sql, rs, windows
from .regimes import HALVES, RET, halves, returns
from .registry import W, chi2_p_sql, f_p2_sql, f_p_sql, query, rounded

_SPIKE = lambda x, bound: f"CASE WHEN {x} > {bound} THEN 1.0::DOUBLE ELSE 0.0 END"
_CHANGE = lambda x, n=1: f"{x} / nullif(lag({x}, {n}) OVER ({W}), 0) - 1"


@query("sentiment_features", B + f""", q AS (SELECT k AS k2, quantile_cont(close, 0.9) AS hi, quantile_cont(close, 0.1) AS lo FROM bars GROUP BY 1),
  s AS (SELECT k, t, close, volume, open, hi, lo, {full_sql('avg(close)', 'close', 3)} AS s3, {full_sql('avg(close)', 'close', 7)} AS s7, {full_sql('stddev_samp(close)', 'close', 7)} AS v7, {full_sql('avg(volume)', 'volume', 7)} AS q7,
    {_CHANGE('close')} AS c1, {_CHANGE('close', 3)} AS c3 FROM bars JOIN q ON k = k2 {windows(3, 7)})
SELECT k, t, {rs('s3')} AS sma_3, {rs('s7')} AS sma_7, {rs('close - s7')} AS momentum, {rs('v7')} AS volatility, {_SPIKE('close', 'hi')} AS bullish, CASE WHEN close < lo THEN 1.0::DOUBLE ELSE 0.0 END AS bearish,
  {rs('c1')} AS change_1, {rs('c3')} AS change_3, {_SPIKE('volume', '2 * q7')} AS volume_spike, {rs('close * volume')} AS volume_product, {rs('close - open')} AS divergence FROM s""")
def sentiment_features(spark: SparkSession, d: str) -> DataFrame:
    """The closing value as the mood, the opening one as the news', counts as the social volume."""
    df = feature_sets.sentiment(tb.hourly(spark, d), "close", by_time(), volume="volume", news="open")
    return rounded(df.select("k", "t", "sma_3", "sma_7", "momentum", "volatility", "bullish", "bearish", "change_1", "change_3", "volume_spike", "volume_product", "divergence"))


@query("on_chain_features", B + f""", s AS (SELECT k, t, high, (close - open) / 100 AS flow, low, close, volume FROM bars), m AS (SELECT *, {full_sql('avg(high)', 'high', 7)} AS h7, {full_sql('avg(high)', 'high', 30)} + 2 * {full_sql('stddev_samp(high)', 'high', 30)} AS h30,
    {full_sql('avg(flow)', 'flow', 7)} AS f7, {_CHANGE('low')} AS lc, {full_sql('avg(close)', 'close', 30)} AS c30, {_CHANGE('volume', 7)} AS g FROM s {windows(7, 30)})
SELECT k, t, {rs('h7')} AS whale_ma7, {_SPIKE('high', 'h30')} AS whale_spike, {rs('flow - f7')} AS flow_trend, CASE WHEN flow < -0.1 THEN 1.0::DOUBLE ELSE 0.0 END AS accumulation, {rs('lc')} AS health_change, {rs('c30')} AS coin_aging, {rs('g')} AS growth_7 FROM m""")
def on_chain_features(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("flow", (F.col("close") - F.col("open")) / 100)
    df = feature_sets.on_chain(df, "high", "flow", "low", "close", "volume", by_time())
    return rounded(df.select("k", "t", "whale_ma7", "whale_spike", "flow_trend", "accumulation", "health_change", "coin_aging", "growth_7"))


@query("macro_features", B + f""", s AS (SELECT k, t, high, low, (close - open) / 100 AS eq, close / 100 AS score, close / 100 - lag(close / 100) OVER ({W}) AS sd, high - lag(high) OVER ({W}) AS dd FROM bars),
  m AS (SELECT *, {full_sql('avg(high)', 'high', 7)} AS r7, {full_sql('avg(dd)', 'dd', 3)} AS a3, {full_sql('avg(low)', 'low', 14)} AS l14 FROM s {windows(3, 7, 14)})
SELECT k, t, {rs('r7')} AS rates_trend, {rs('a3')} AS rates_acceleration, {rs('low - l14')} AS dollar_momentum, CASE WHEN eq > 0.1 THEN 1 WHEN eq < -0.1 THEN -1 ELSE 0 END AS risk_on_off, {_SPIKE('abs(sd)', '0.2')} AS regime_change FROM m""")
def macro_features(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumns({"equity": (F.col("close") - F.col("open")) / 100, "score": F.col("close") / 100})
    df = feature_sets.macro(df, "high", "low", "equity", "score", by_time())
    return rounded(df.select("k", "t", "rates_trend", "rates_acceleration", "dollar_momentum", "risk_on_off", "regime_change"))


def _granger_sql(effect: str, own: str, cause: str) -> str:
    """F from the two residual sums, by the R^2 of the restricted and the full regression (not by the partial correlation)."""
    a, b, r = f"corr({effect}, {cause})", f"corr({effect}, {own})", "corr(xl, yl)"
    full_r2 = f"(({a}) ** 2 + ({b}) ** 2 - 2 * ({a}) * ({b}) * {r}) / nullif(1 - {r} ** 2, 0)"
    return f"({full_r2} - ({b}) ** 2) * (count(*) - 3) / nullif(1 - {full_r2}, 0)"


@query("granger", B + f""", l AS (SELECT k, close AS x, volume AS y, lag(close) OVER ({W}) AS xl, lag(volume) OVER ({W}) AS yl FROM bars), c AS (SELECT * FROM l WHERE xl IS NOT NULL),
  f AS (SELECT k, count(*) AS n, {_granger_sql('y', 'yl', 'xl')} AS a, {_granger_sql('x', 'xl', 'yl')} AS b FROM c GROUP BY k HAVING count(*) > 3)
SELECT k, {rs('a')} AS x_to_y, {rs('b')} AS y_to_x, {rs(f_p_sql('a', '1', 'n - 3'))} AS x_to_y_p, {rs(f_p_sql('b', '1', 'n - 3'))} AS y_to_x_p FROM f""")
def granger(spark: SparkSession, d: str) -> DataFrame:
    """Price and volume, each as the cause of the other."""
    return rounded(significance.granger(tb.hourly(spark, d), "close", "volume", by_time(), ["k"]))


@query("two_components", B + f""", v AS (SELECT k, var_samp(close) AS a, var_samp(volume) AS b, covar_samp(close, volume) AS c FROM bars GROUP BY 1), e AS (SELECT k, (a + b + sqrt((a - b) ** 2 + 4 * c * c)) / 2 / (a + b) AS s FROM v) SELECT k, {rs('s')} AS share_1, {rs('1 - s')} AS share_2 FROM e""")
def two_components(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.two_components(tb.hourly(spark, d), "close", "volume", ["k"]))


@query("arch_lm", B + f""", {RET}, q AS (SELECT k, t, (r - avg(r) OVER (PARTITION BY k)) ** 2 AS q FROM r WHERE r IS NOT NULL), l AS (SELECT k, q, lag(q) OVER ({W}) AS l FROM q),
  s AS (SELECT k, count(*) AS n, count(*) * regr_r2(q, l) AS lm FROM l WHERE l IS NOT NULL GROUP BY 1) SELECT k, n, {rs('lm')} AS lm, {rs(chi2_p_sql('lm', 1))} AS p FROM s""")
def arch_lm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.arch_lm(returns(spark, d), "r", by_time(), ["k"]))


@query("equal_variance", B + f""", {RET}, {HALVES}, m AS (SELECT k, g, median(r) AS md FROM h GROUP BY 1, 2), z AS (SELECT h.k, h.g, r, abs(r - md) AS z FROM h JOIN m USING (k, g)),
  a AS (SELECT k, count(*) AS n, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, var_samp(r) FILTER (g = 1) AS v1, var_samp(r) FILTER (g = 0) AS v0, var_pop(z) * count(*) AS total, var_pop(z) FILTER (g = 1) * count(*) FILTER (g = 1) + var_pop(z) FILTER (g = 0) * count(*) FILTER (g = 0) AS inner_ FROM z GROUP BY 1),
  s AS (SELECT k, n1, n0, (n - 2) * (total - inner_) / inner_ AS le, ((n - 2) * ln(((n1 - 1) * v1 + (n0 - 1) * v0) / (n - 2)) - (n1 - 1) * ln(v1) - (n0 - 1) * ln(v0)) / (1 + (1.0 / (n1 - 1) + 1.0 / (n0 - 1) - 1.0 / (n - 2)) / 3) AS ba, v1 / nullif(v0, 0) AS f, n FROM a)
SELECT k, {rs('le')} AS levene, {rs('ba')} AS bartlett, {rs('f')} AS f_ratio, {rs(f_p_sql('le', '1', 'n - 2'))} AS levene_p, {rs(chi2_p_sql('ba', 1))} AS bartlett_p, {rs(f_p2_sql('f', 'n1 - 1', 'n0 - 1'))} AS f_ratio_p FROM s""")
def equal_variance(spark: SparkSession, d: str) -> DataFrame:
    """The returns of the second half of each key's bars against the first."""
    return rounded(significance.equal_variance(halves(spark, d), "r", "g", ["k"]))


@query("ljung_box", B + f""", {RET}, c AS (SELECT k, t, r - avg(r) OVER (PARTITION BY k) AS d FROM r WHERE r IS NOT NULL), i AS (SELECT *, row_number() OVER ({W}) AS i FROM c), n AS (SELECT k, count(*) AS n, sum(d * d) AS v FROM c GROUP BY 1),
  g AS (SELECT a.k, b.i - a.i AS lag, sum(a.d * b.d) AS c FROM i a JOIN i b ON a.k = b.k AND b.i - a.i BETWEEN 1 AND 10 GROUP BY 1, 2), q AS (SELECT k, n, n * (n + 2) * sum((c / v) ** 2 / (n - lag)) AS q FROM g JOIN n USING (k) GROUP BY k, n) SELECT k, n, {rs('q')} AS q, {rs(chi2_p_sql('q', 10))} AS p FROM q""")
def ljung_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.ljung_box(returns(spark, d), "r", by_time(), 10, ["k"]))


def _mi_sql(name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT k, sum(n / s * ln(n * s / (sa * sb))) AS mi FROM (SELECT k, n::DOUBLE AS n, sum(n) OVER (PARTITION BY k) AS s, sum(n) OVER (PARTITION BY k, a) AS sa, sum(n) OVER (PARTITION BY k, b) AS sb
    FROM (SELECT k, {a} AS a, {b} AS b, count(*) AS n FROM z WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY 1)"""


@query("information_flow", B + f""", e AS (SELECT k, t, close, min(close) OVER (PARTITION BY k) AS lo, max(close) OVER (PARTITION BY k) AS hi FROM bars), y AS (SELECT k, t, least(floor((close - lo) * 10 / (hi - lo)), 9) AS b FROM e),
  z AS (SELECT k, b, lag(b) OVER ({W}) AS b1, lag(b, 2) OVER ({W}) AS b2 FROM y), {_mi_sql('m1', 'b1', 'b')}, {_mi_sql('m2', 'b2', 'b')} SELECT k, {rs('m1.mi')} AS lag_1, {rs('m2.mi - m1.mi')} AS transfer FROM m1 JOIN m2 USING (k)""")
def information_flow(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information (ten bins, nats) of a value with the one before, and the gain of the one before that over it."""
    o = by_time()
    z = significance.equal_bins(tb.hourly(spark, d), "close", 10, ["k"], "b")
    z = z.select("k", "b", F.lag("b").over(o).alias("b1"), F.lag("b", 2).over(o).alias("b2"))
    one = significance.mutual_information(z, "b1", "b", ["k"]).withColumnRenamed("mi", "lag_1")
    two = significance.mutual_information(z, "b2", "b", ["k"])
    return rounded(one.join(two, "k").select("k", "lag_1", (F.col("mi") - F.col("lag_1")).alias("transfer")))


_LIKE = lambda x: f"(greatest(0, 1 - abs(avg({x}) FILTER (g = 0) - avg({x}) FILTER (g = 1)) / (abs(avg({x}) FILTER (g = 0)) + 1e-8)) + greatest(0, 1 - abs(stddev_samp({x}) FILTER (g = 0) - stddev_samp({x}) FILTER (g = 1)) / (abs(stddev_samp({x}) FILTER (g = 0)) + 1e-8))) / 2"


@query("likeness", "WITH e AS (SELECT event_type AS k, value, user_id::DOUBLE AS user_id, event_id % 2 AS g FROM events) " + " UNION ALL ".join(f"SELECT k, '{x}' AS feature, {rs(_LIKE(x))} AS similarity FROM e GROUP BY k" for x in ("value", "user_id")))
def likeness(spark: SparkSession, d: str) -> DataFrame:
    """Odd events (as the generated rows) against even ones."""
    df = tb.events(spark, d).select(F.col("event_type").alias("k"), "value", F.col("user_id").cast("double").alias("user_id"), (F.col("event_id") % 2).alias("g"))
    return rounded(significance.likeness(df, ["value", "user_id"], "g", ["k"]))


@query("extrapolate", B + f""", n AS (SELECT k, t, close, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY k) AS n FROM bars), s AS (SELECT k, t, i, CASE WHEN i > 3 AND i <= n - 3 AND i % 5 <> 0 THEN close END AS x FROM n), l AS (SELECT *, coalesce(max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY k ORDER BY i), 0) AS last FROM s),
  p AS (SELECT k, i, x, lead(x) OVER o AS nx, lead(i) OVER o AS ni, lag(x) OVER o AS px, lag(i) OVER o AS pi FROM s WHERE x IS NOT NULL WINDOW o AS (PARTITION BY k ORDER BY i)), b AS (SELECT k, min(i) AS a, max(i) AS z FROM p GROUP BY 1)
SELECT s.k, s.t, {rs('''coalesce(s.x, CASE WHEN s.i > b.z THEN p.x + (s.i - p.i) * (p.x - p.px) / (p.i - p.pi) ELSE p.x + (s.i - p.i) * (p.nx - p.x) / (p.ni - p.i) END)''')} AS x
FROM l AS s JOIN b ON s.k = b.k LEFT JOIN p ON p.k = s.k AND p.i = greatest(s.last, b.a)""")
def extrapolate(spark: SparkSession, d: str) -> DataFrame:
    """Closing values without every fifth, the first three and the last three."""
    i, n = F.row_number().over(by_time()), F.count("*").over(Window.partitionBy("k"))
    df = tb.hourly(spark, d).withColumns({"i": i, "n": n}).select("k", "t", F.when((F.col("i") > 3) & (F.col("i") <= F.col("n") - 3) & (F.col("i") % 5 != 0), F.col("close")).alias("x"))
    return rounded(fill.extrapolate(df, "x", by_time()).select("k", "t", "x"))


@query("local_line", B.replace("'hour'", "'day'") + f""", n AS (SELECT k, t, close, row_number() OVER ({W}) - 1 AS i, ceil(0.3 * count(*) OVER (PARTITION BY k)) AS h FROM bars),
  f AS (SELECT a.k, a.t, a.i, sum((1 - abs(b.i - a.i) / a.h) * b.i * b.close) AS xy, sum((1 - abs(b.i - a.i) / a.h) * b.i * b.i) AS xx FROM n a JOIN n b ON a.k = b.k AND abs(b.i - a.i) <= floor(a.h / 2) GROUP BY 1, 2, 3) SELECT k, t, {rs('xy / xx * i')} AS trend FROM f""")
def local_line(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fill.local_line(tb.daily(spark, d), "close", by_time()).select("k", "t", "trend"))


@query("adaptive_folds", B + f""", i AS (SELECT k, t, close, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars),
  v AS (SELECT a.k, a.i, a.n, stddev_samp(b.r) AS v FROM i a JOIN i b ON a.k = b.k AND b.i < a.i AND b.i > a.i - 48 WHERE a.i >= 60 AND (a.i - 60) % 24 = 0 AND a.i < a.n - 24 GROUP BY 1, 2, 3)
SELECT k, ((i - 60) // 24 + 1)::INTEGER AS fold, {rs('v')} AS volatility, i - least(CASE WHEN v > 6 THEN 60 ELSE 120 END, i) AS train_start, i AS train_stop, least(i + CASE WHEN v > 6 THEN 12 ELSE 24 END, n) AS test_stop FROM v""")
def adaptive_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds of 60 or 120 hours, by whether the last two days' returns spread more than 6."""
    return rounded(predictions.adaptive_folds(tb.hourly(spark, d), "close", by_time(), least=60, most=120, test=24, step=24, lookback=48, bound=6.0))


@query("tail_value_at_risk", B + f""", {RET}, q AS (SELECT k, quantile_cont(r, 0.05) AS u FROM r GROUP BY 1 HAVING count(r) >= 100), e AS (SELECT k, u, avg(u - r) AS m, var_samp(u - r) AS v FROM r JOIN q USING (k) WHERE r <= u GROUP BY 1, 2 HAVING count(*) >= 20),
  g AS (SELECT k, u, (1 - m * m / v) / 2 AS s, m * (1 + m * m / v) / 2 AS b FROM e), x AS (SELECT *, pow(0.2, -s) AS p, u - b * (pow(0.2, -s) - 1) / s AS var FROM g)
SELECT k, {rs('u')} AS threshold, {rs('s')} AS shape, {rs('b')} AS scale, {rs('var')} AS var, {rs('var - b / (1 - s) * p')} AS cvar FROM x""")
def tail_value_at_risk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.tail_value_at_risk(returns(spark, d), "r", ["k"]))
