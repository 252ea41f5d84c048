"""Regimes, levels, scores, tests of significance and backtest frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import pct_change, ratio, rolling, rows, running, sma, so_far
from ..operators import ewm, predictions, regimes, significance
from ..operators import indicators as ind
from ..sources import tables as tb
from ..sources.tables import by_time
from .indicators import B, full_sql, rs, windows
from .registry import W, chi2_p_sql, f_p2_sql, f_p_sql, query, r6, rounded, t_p_sql

_R = f"(close / nullif(lag(close) OVER ({W}), 0) - 1)"
RET = f"r AS (SELECT *, {_R} AS r, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY k) AS n FROM bars)"


def returns(spark: SparkSession, d: str) -> DataFrame:
    return tb.hourly(spark, d).withColumn("r", pct_change("close", by_time()))


@query("regime_seven", B + f""", {RET}, m AS (SELECT k, t, {', '.join(f'100 * (close / lag(close, {n - 1}) OVER ({W}) - 1) AS t{n}' for n in (24, 72, 168))}, 100 * stddev_samp(r) OVER w168 AS v FROM r {windows(168)}),
  f AS (SELECT k, t, t24, t72, t168, CASE WHEN t168 IS NOT NULL THEN v END AS v FROM m)
SELECT k, t, {rs('t24')} AS short, {rs('t72')} AS medium, {rs('t168')} AS long, {rs('v')} AS vol, CASE WHEN t168 IS NULL THEN NULL WHEN t168 > 5 AND t72 > 2 AND v < 4 THEN 'strong_bull' WHEN t168 > 2 AND t72 > 0 THEN 'bull_market'
  WHEN t168 < -5 AND t72 < -2 AND v < 4 THEN 'strong_bear' WHEN t168 < -2 AND t72 < 0 THEN 'bear_market' WHEN v > 6 THEN 'high_volatility' WHEN abs(t168) < 2 AND v < 3 THEN 'sideways' ELSE 'transitional' END AS regime FROM f""")
def regime_seven(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regimes.seven_way(tb.hourly(spark, d), by_time()).select("k", "t", "short", "medium", "long", "vol", "regime"))


@query("regime_eight", B + f""", {RET}, m AS (SELECT k, t, {full_sql('avg(r)', 'r', 20)} AS m, {full_sql('stddev_samp(r)', 'r', 20)} * sqrt(252.0) AS v, {full_sql('sum(r)', 'r', 20)} AS p FROM r {windows(20)})
SELECT k, t, {rs('m')} AS mean, {rs('v')} AS vol, CASE WHEN m IS NULL OR v IS NULL THEN 'sideways_low_vol' WHEN m < -0.2 THEN 'crisis' WHEN m > 0.1 AND coalesce(p, 0) > 0.05 THEN 'recovery'
  ELSE CASE WHEN m > 0.15 THEN 'bull' WHEN m < -0.15 THEN 'bear' ELSE 'sideways' END || CASE WHEN v > 0.6 THEN '_high_vol' ELSE '_low_vol' END END AS regime FROM m""")
def regime_eight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regimes.eight_way(tb.hourly(spark, d), by_time()).select("k", "t", "mean", "vol", "regime"))


@query("regime_six", B + f""", {RET}, m AS (SELECT k, t, {full_sql('covar_samp(i, close)', 'close', 60)} / {full_sql('var_samp(i)', 'close', 60)} / {full_sql('avg(close)', 'close', 60)} AS tr, {full_sql('stddev_samp(r)', 'r', 60)} * sqrt(365.0) AS v FROM r {windows(60)}),
  q AS (SELECT *, (SELECT median(v) FROM m x WHERE x.k = m.k) AS md FROM m)
SELECT k, t, {rs('tr')} AS trend, {rs('v')} AS vol, CASE WHEN tr IS NULL OR v IS NULL THEN NULL WHEN abs(tr) > 0.001 THEN CASE WHEN tr > 0.001 THEN 'bull' ELSE 'bear' END || CASE WHEN v < 1.2 * md THEN '_low_vol' ELSE '_high_vol' END
  WHEN v < md THEN 'sideways_low_vol' ELSE 'sideways_high_vol' END AS regime FROM q""".replace("median(v)", "median(v)"))
def regime_six(spark: SparkSession, d: str) -> DataFrame:
    """Hourly slopes are small: a trend counts from a thousandth of the mean an hour."""
    return rounded(regimes.six_way(tb.hourly(spark, d), by_time(), steep=0.001).select("k", "t", "trend", "vol", "regime"))


@query("regime_three", B + f", m AS (SELECT k, t, (close - lag(close, 24) OVER ({W})) / lag(close, 24) OVER ({W}) AS tr FROM bars) SELECT k, t, CASE WHEN tr > 0.01 THEN 'bull_market' WHEN tr < -0.01 THEN 'bear_market' ELSE 'sideways' END AS regime FROM m")
def regime_three(spark: SparkSession, d: str) -> DataFrame:
    return regimes.three_way(tb.hourly(spark, d), by_time()).select("k", "t", "regime")


@query("regime_vote", B + f""", {RET}, m AS (SELECT k, t, {full_sql('covar_samp(i, close)', 'close', 20)} / {full_sql('var_samp(i)', 'close', 20)} AS tr, {full_sql('avg(close)', 'close', 20)} AS ma,
    {full_sql('stddev_samp(r)', 'r', 20)} / nullif({full_sql('stddev_samp(r)', 'r', 100)}, 0) AS vr, volume / nullif({full_sql('avg(volume)', 'volume', 20)}, 0) AS qr FROM r {windows(20, 100)}),
  p AS (SELECT k, t, tr, least(abs(tr) * 20 / ma, 1.0) AS st, vr, qr FROM m WHERE tr IS NOT NULL AND vr IS NOT NULL AND qr IS NOT NULL),
  s AS (SELECT k, t, CASE WHEN tr > 0 THEN 0.4 * least(st, 1.0) ELSE 0 END + CASE WHEN qr > 1.2 THEN 0.3 ELSE 0 END + CASE WHEN vr < 1.2 THEN 0.3 ELSE 0 END AS bull,
    CASE WHEN tr < 0 THEN 0.4 * least(st, 1.0) ELSE 0 END + CASE WHEN qr > 1.1 THEN 0.3 ELSE 0 END + CASE WHEN vr > 0.8 THEN 0.3 ELSE 0 END AS bear,
    CASE WHEN st < 0.3 THEN 0.5 ELSE 0 END + CASE WHEN vr < 1.5 THEN 0.3 ELSE 0 END + CASE WHEN qr > 0.8 AND qr < 1.2 THEN 0.2 ELSE 0 END AS sideways,
    CASE WHEN vr > 2.0 THEN 0.6 ELSE 0 END + CASE WHEN qr > 1.5 THEN 0.4 ELSE 0 END AS volatile FROM p),
  b AS (SELECT *, greatest(bull, bear, sideways, volatile) AS best FROM (SELECT k, t, round(bull, 9) AS bull, round(bear, 9) AS bear, round(sideways, 9) AS sideways, round(volatile, 9) AS volatile FROM s))
SELECT k, t, CASE best WHEN bull THEN 'bull' WHEN bear THEN 'bear' WHEN sideways THEN 'sideways' ELSE 'volatile' END AS regime, {rs('best')} AS score FROM b""")
def regime_vote(spark: SparkSession, d: str) -> DataFrame:
    o = by_time()
    df = returns(spark, d).withColumn("i", F.row_number().over(o).cast("double"))
    f20 = rows(o, 20)
    slope = F.when(F.count("close").over(f20) == 20, F.covar_samp("i", "close").over(f20) / F.var_samp("i").over(f20))
    df = df.withColumns({"tr": slope, "ma": sma("close", o, 20), "vr": ratio(rolling("std", "r", o, 20), rolling("std", "r", o, 100)), "qr": ratio("volume", sma("volume", o, 20))})
    df = df.where("tr IS NOT NULL AND vr IS NOT NULL AND qr IS NOT NULL").withColumn("st", F.least(F.abs("tr") * 20 / F.col("ma"), F.lit(1.0)))
    scores = {n: F.round(s, 9) for n, s in regimes.regime_scores(F.col("tr"), F.col("st"), F.col("vr"), F.col("qr")).items()}
    name, best = regimes.vote(scores)
    return df.select("k", "t", name.alias("regime"), r6(best).alias("score"))


@query("dynamic_levels", B + f""", m AS (SELECT k, t, close, {', '.join(full_sql('avg(close)', 'close', n) + f' AS ma{n}' for n in (20, 50, 100, 200))}, {full_sql('stddev_samp(close)', 'close', 20)} AS sd FROM bars {windows(20, 50, 100, 200)})
SELECT k, t, {', '.join(rs(f'ma{n}') + f' AS ma{n}' for n in (20, 50, 100, 200))}, {rs('ma20 + 2 * sd')} AS upper, {rs('ma20 - 2 * sd')} AS lower,
  {rs('100 * (close - ma20) / close')} AS ma20_distance_pct, CASE WHEN ma20 IS NULL THEN NULL WHEN close > ma20 THEN 'support' ELSE 'resistance' END AS ma20_role FROM m""")
def dynamic_levels(spark: SparkSession, d: str) -> DataFrame:
    """Moving averages and bands as levels: support below the price, resistance above."""
    o = by_time()
    df = tb.hourly(spark, d).withColumns({f"ma{n}": sma("close", o, n) for n in (20, 50, 100, 200)} | {"sd": rolling("std", "close", o, 20)})
    role = F.when(F.col("ma20").isNull(), None).when(F.col("close") > F.col("ma20"), "support").otherwise("resistance")
    return rounded(df.select("k", "t", "ma20", "ma50", "ma100", "ma200", (F.col("ma20") + 2 * F.col("sd")).alias("upper"), (F.col("ma20") - 2 * F.col("sd")).alias("lower"), (100 * (F.col("close") - F.col("ma20")) / F.col("close")).alias("ma20_distance_pct"), role.alias("ma20_role")))


def _wilder(x: str, src: str) -> str:
    """SQL of Wilder's mean by its closed form."""
    return f"(SELECT a.k, a.i, sum(b.{x} * pow(13.0 / 14, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE 1.0 / 14 END) AS e FROM {src} a JOIN {src} b ON a.k = b.k AND b.i <= a.i GROUP BY 1, 2)"


@query("adx", B + f""", p AS (SELECT k, t, row_number() OVER ({W}) AS i, high - lag(high) OVER ({W}) AS u, lag(low) OVER ({W}) - low AS dn, high - low AS hl, abs(high - lag(close) OVER ({W})) AS hc, abs(low - lag(close) OVER ({W})) AS lc FROM bars),
  d AS (SELECT k, t, i, CASE WHEN u > dn AND u > 0 THEN u ELSE 0 END AS pdm, CASE WHEN dn > u AND dn > 0 THEN dn ELSE 0 END AS mdm, greatest(hl, coalesce(hc, hl), coalesce(lc, hl)) AS tr FROM p),
  a AS {_wilder('pdm', 'd')}, b AS {_wilder('mdm', 'd')}, c AS {_wilder('tr', 'd')},
  x AS (SELECT k, i, 100 * a.e / nullif(c.e, 0) AS pdi, 100 * b.e / nullif(c.e, 0) AS mdi FROM a JOIN b USING (k, i) JOIN c USING (k, i)),
  y AS (SELECT k, i, pdi, mdi, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx FROM x), z AS {_wilder('dx', 'y')}
SELECT k, t, {rs('pdi')} AS plus_di, {rs('mdi')} AS minus_di, {rs('z.e')} AS adx FROM d JOIN y USING (k, i) JOIN z USING (k, i)""")
def adx(spark: SparkSession, d: str) -> DataFrame:
    """Directional movement, its index and the average index, all by Wilder's mean over 14 rows; the first row begins the means."""
    o = by_time()
    up, down = F.col("high") - F.lag("high").over(o), F.lag("low").over(o) - F.col("low")
    df = tb.hourly(spark, d).withColumns({"u": up, "dn": down, "tr": ind.true_range(o), "i": F.row_number().over(o)})
    df = df.select("k", "t", F.when((F.col("u") > F.col("dn")) & (F.col("u") > 0), F.col("u")).otherwise(0.0).alias("p"), F.when((F.col("dn") > F.col("u")) & (F.col("dn") > 0), F.col("dn")).otherwise(0.0).alias("m"), F.coalesce("tr", F.col("high") - F.col("low")).alias("tr"))
    df = ewm.ewm_many(df, [("p", "ep", 1 / 14, False), ("m", "em", 1 / 14, False), ("tr", "et", 1 / 14, False)])
    df = df.withColumn("plus_di", 100 * ratio("ep", "et")).withColumn("minus_di", 100 * ratio("em", "et"))
    df = df.withColumn("dx", F.coalesce(100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")), F.lit(0.0)))
    df = ewm.ewm_many(df.select("k", "t", "plus_di", "minus_di", "dx"), [("dx", "adx", 1 / 14, False)])
    return rounded(df.select("k", "t", "plus_di", "minus_di", "adx"))


@query("ultimate_oscillator", B + f""", p AS (SELECT k, t, close - least(low, lag(close) OVER ({W})) AS bp, greatest(high, lag(close) OVER ({W})) - least(low, lag(close) OVER ({W})) AS tr, lag(close) OVER ({W}) AS pc FROM bars),
  q AS (SELECT k, t, CASE WHEN pc IS NOT NULL THEN bp END AS bp, CASE WHEN pc IS NOT NULL THEN tr END AS tr FROM p),
  m AS (SELECT k, t, {', '.join(f"{full_sql('sum(bp)', 'bp', n)} / nullif({full_sql('sum(tr)', 'tr', n)}, 0) AS a{n}" for n in (7, 14, 28))} FROM q {windows(7, 14, 28)})
SELECT k, t, {rs('100 * (4 * a7 + 2 * a14 + a28) / 7')} AS uo FROM m""")
def ultimate_oscillator(spark: SparkSession, d: str) -> DataFrame:
    o = by_time()
    last = F.lag("close").over(o)
    df = tb.hourly(spark, d).withColumn("pc", last)
    known = F.col("pc").isNotNull()
    low = F.least("low", "pc")
    df = df.withColumns({"bp": F.when(known, F.col("close") - low), "tr": F.when(known, F.greatest("high", "pc") - low)})
    share = {n: ratio(rolling("sum", "bp", o, n), rolling("sum", "tr", o, n)) for n in (7, 14, 28)}
    return df.select("k", "t", r6(100 * (4 * share[7] + 2 * share[14] + share[28]) / 7).alias("uo"))


@query("option_flow", f"""WITH o AS (SELECT l_shipdate::TIMESTAMP AS t, CASE WHEN l_returnflag = 'A' THEN 'call' ELSE 'put' END AS kind, l_extendedprice / l_quantity AS strike, l_quantity AS volume FROM lineitem WHERE l_returnflag IN ('A', 'R')),
  s AS (SELECT t, avg(strike) AS spot FROM o GROUP BY 1), f AS (SELECT t, coalesce(sum(volume * strike) FILTER (kind = 'call' AND strike / spot >= 1), 0) AS bull, coalesce(sum(volume * strike) FILTER (kind = 'put' AND strike / spot <= 1), 0) AS bear FROM o JOIN s USING (t) GROUP BY 1),
  g AS (SELECT t, bull, bear, (bull - bear) / greatest(bull + bear, 1) AS net FROM f)
SELECT t, {rs('bull')} AS bullish, {rs('bear')} AS bearish, {rs('net')} AS net, CASE WHEN net > 0.2 THEN 'BULLISH' WHEN net < -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment FROM g""")
def option_flow(spark: SparkSession, d: str) -> DataFrame:
    """Traded value of calls at or above and of puts at or below the spot (the day's mean strike), by day."""
    o = tb.trades(spark, d).where("k IN ('A', 'R')").select("t", "k", F.col("price").alias("strike"), F.col("size").alias("volume"))
    o = o.join(o.groupBy("t").agg(F.avg("strike").alias("spot")), "t")
    flow, at = F.col("volume") * F.col("strike"), F.col("strike") / F.col("spot")
    f = o.groupBy("t").agg(F.coalesce(F.sum(F.when((F.col("k") == "A") & (at >= 1), flow)), F.lit(0.0)).alias("bullish"), F.coalesce(F.sum(F.when((F.col("k") == "R") & (at <= 1), flow)), F.lit(0.0)).alias("bearish"))
    f = f.withColumn("net", (F.col("bullish") - F.col("bearish")) / F.greatest(F.col("bullish") + F.col("bearish"), F.lit(1.0)))
    return rounded(f.withColumn("sentiment", F.when(F.col("net") > 0.2, "BULLISH").when(F.col("net") < -0.2, "BEARISH").otherwise("NEUTRAL")))


HALVES = f"h AS (SELECT k, t, r, CASE WHEN i * 2 > n THEN 1 ELSE 0 END AS g FROM r WHERE r IS NOT NULL)"


def halves(spark: SparkSession, d: str) -> DataFrame:
    """Returns of the first half (group 0) and the second (1) of each key's bars."""
    n = F.count("*").over(Window.partitionBy("k"))
    df = returns(spark, d).withColumn("i", F.row_number().over(by_time())).withColumn("n", n).where("r IS NOT NULL")
    return df.select("k", "t", "r", F.when(F.col("i") * 2 > F.col("n"), 1).otherwise(0).alias("g"))


@query("effect_sizes", B + f""", {RET}, {HALVES}, a AS (SELECT k, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, avg(r) FILTER (g = 1) AS m1, avg(r) FILTER (g = 0) AS m0, var_samp(r) FILTER (g = 1) AS v1, var_samp(r) FILTER (g = 0) AS v0 FROM h GROUP BY 1),
  e AS (SELECT *, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS p FROM a), c AS (SELECT *, (m1 - m0) / nullif(p, 0) AS d FROM e)
SELECT k, n1, n0, {rs('d')} AS cohen_d, {rs('d * (1 - 3.0 / (4 * (n1 + n0 - 2) - 1))')} AS hedges_g, {rs('(m1 - m0) / nullif(sqrt(v0), 0)')} AS glass_delta, {rs('(m1 - m0) / nullif(p * sqrt(1.0 / n1 + 1.0 / n0), 0)')} AS t_stat, {rs(t_p_sql('(m1 - m0) / nullif(p * sqrt(1.0 / n1 + 1.0 / n0), 0)', 'n1 + n0 - 2'))} AS t_p,
  CASE WHEN d IS NULL THEN NULL WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM c""")
def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.effect_sizes(halves(spark, d), "r", "g", ["k"]))


@query("rank_sum", B + f""", {RET}, {HALVES}, q AS (SELECT k, g, rank() OVER (PARTITION BY k ORDER BY r) + (count(*) OVER (PARTITION BY k, r) - 1) / 2.0 AS rk FROM h),
  a AS (SELECT k, sum(rk) FILTER (g = 1) AS w, count(*) FILTER (g = 1) AS a, count(*) FILTER (g = 0) AS b FROM q GROUP BY 1), t AS (SELECT k, sum(c ** 3 - c) AS ties FROM (SELECT k, r, count(*)::DOUBLE AS c FROM h GROUP BY 1, 2) GROUP BY 1),
  z AS (SELECT k, (w - a * (a + b + 1) / 2.0) / sqrt(a * b / 12.0 * (a + b + 1 - ties / ((a + b) * (a + b - 1.0)))) AS z FROM a JOIN t USING (k)) SELECT k, {rs('z')} AS rank_sum_z, {rs(chi2_p_sql('z * z', 1))} AS rank_sum_p FROM z""")
def rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.rank_sum(halves(spark, d), "r", "g", ["k"]))


@query("ks_tests", B + f""", {RET}, {HALVES}, v AS (SELECT k, r, count(*) FILTER (g = 1) AS a, count(*) FILTER (g = 0) AS b FROM h GROUP BY 1, 2), c AS (SELECT k, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM v WINDOW o AS (PARTITION BY k ORDER BY r), p AS (PARTITION BY k)),
  s AS (SELECT k, max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))) AS ks, max(sqrt(na * nb / (na + nb))) AS e FROM c GROUP BY 1),
  p AS (SELECT k, ks, least(greatest(2 * ({' + '.join(f'({(-1) ** (j - 1)}) * exp(-2.0 * {j} * {j} * (e * ks) * (e * ks))' for j in range(1, 21))}), 0.0), 1.0) AS p FROM s),
  m AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, k) AS rn FROM p)
SELECT k, {rs('ks')} AS ks, {rs('p')} AS p, {rs('least(p * m, 1.0)')} AS bonferroni, {rs('least(max((m - rn + 1) * p) OVER (ORDER BY p, k), 1.0)')} AS holm FROM m""")
def ks_tests(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.adjusted(significance.kolmogorov_smirnov(halves(spark, d), "r", "g", ["k"]), "p", "k"))


@query("variance_change", B + f""", {RET}, v AS (SELECT k, t, r, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, var_pop(r) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, var_pop(r) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM r WHERE r IS NOT NULL),
  f AS (SELECT k, t, i, n, CASE WHEN i >= 30 AND n - i > 30 THEN CASE WHEN b > 0 THEN a / b ELSE 1 END END AS f FROM v), p AS (SELECT k, t, f, CASE WHEN f IS NOT NULL THEN {f_p2_sql('f', 'n - i - 1', 'i - 1')} END AS p FROM f)
SELECT k, t, {rs('f')} AS f_stat, {rs('p')} AS f_p, coalesce(p < 0.01, false) AS change_point FROM p""")
def variance_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.variance_change(returns(spark, d).select("k", "t", "r"), "r", by_time(), 30).drop("r"))


_FEATURES = f"f AS (SELECT k, t, lead(r) OVER ({W}) AS y, r, lag(r) OVER ({W}) AS lag_1, {full_sql('stddev_samp(r)', 'r', 24)} AS vol, {full_sql('avg(r)', 'r', 6)} AS momentum FROM r {windows(6, 24)})"


@query("f_regression", B + f", {RET}, {_FEATURES}, u AS (" + " UNION ALL ".join(f"SELECT k, '{n}' AS feature, corr({n}, y) AS c, count(*) FILTER ({n} IS NOT NULL AND y IS NOT NULL) AS n FROM f GROUP BY k" for n in ("r", "lag_1", "vol", "momentum")) + f"), v AS (SELECT k, feature, n, c * c * (n - 2) / nullif(1 - c * c, 0) AS f FROM u) SELECT k, feature, {rs('f')} AS f, {rs(f_p_sql('f', '1', 'n - 2'))} AS p FROM v")
def f_regression(spark: SparkSession, d: str) -> DataFrame:
    o = by_time()
    df = returns(spark, d).select("k", "t", F.lead("r").over(o).alias("y"), "r", F.lag("r").over(o).alias("lag_1"), rolling("std", "r", o, 24).alias("vol"), sma("r", o, 6).alias("momentum"))
    return rounded(significance.f_regression(df, "y", ["r", "lag_1", "vol", "momentum"], ["k"]))


@query("segment_stability", B + f""", {RET}, s AS (SELECT k, (i - 1) * 5 // n AS p, avg(close) AS m, stddev_samp(close) AS s FROM r GROUP BY 1, 2)
SELECT k, count(*) AS segments, {rs('stddev_samp(m) / nullif(avg(abs(m)), 0)')} AS mean_spread, {rs('stddev_samp(s) / nullif(avg(abs(s)), 0)')} AS std_spread FROM s GROUP BY 1""")
def segment_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(significance.segment_stability(tb.hourly(spark, d), "close", by_time(), 5))


@query("blocking_folds", B + f""", {RET}, b AS (SELECT k, t, i - 1 AS i, n, CASE WHEN 5 * greatest(50, n // 15) + 20 > n THEN (n - 20) // 5 ELSE greatest(50, n // 15) END AS size FROM r), f AS (SELECT k, t, i // (size + 5) AS b, unnest([0, 1, 2, 3, 4]) AS fold FROM b WHERE i % (size + 5) < size AND i // (size + 5) < 5)
SELECT k, fold::INTEGER AS fold, CASE WHEN b = fold THEN 'test' ELSE 'train' END AS part, count(*) AS n, min(t) AS start, max(t) AS stop FROM f GROUP BY 1, 2, 3""")
def blocking_folds(spark: SparkSession, d: str) -> DataFrame:
    df = predictions.blocking(tb.hourly(spark, d).select("k", "t"), by_time(), 5, separation=5)
    return df.groupBy("k", "fold", "part").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("stop"))


_FOLDS = f"""x AS (SELECT k, row_number() OVER ({W}) - 1 AS i, r, lead(r) OVER ({W}) AS y, count(*) OVER (PARTITION BY k) AS n FROM r), f AS (SELECT k, i, r, y, unnest(generate_series(0, (n - 125) // 20)) AS fold FROM x WHERE n >= 125),
  p AS (SELECT k, fold, r, y, CASE WHEN i - 20 * fold < 100 THEN 'train' ELSE 'test' END AS part FROM f WHERE r IS NOT NULL AND y IS NOT NULL AND (i - 20 * fold BETWEEN 0 AND 99 OR i - 20 * fold BETWEEN 105 AND 124)),
  c AS (SELECT k, fold, regr_slope(y, r) AS b, regr_intercept(y, r) AS a FROM p WHERE part = 'train' GROUP BY 1, 2), e AS (SELECT k, fold, part, y, a + b * r AS p FROM p JOIN c USING (k, fold)),
  s AS (SELECT k, fold, part, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(*), 0) AS r2, avg(CASE WHEN (p > 0) = (y > 0) THEN 1.0 ELSE 0.0 END) AS direction_accuracy FROM e GROUP BY 1, 2, 3),
  l AS (UNPIVOT s ON mae, rmse, r2, direction_accuracy INTO NAME metric VALUE v),
  m AS (SELECT k, metric, count(DISTINCT fold) AS folds, avg(v) FILTER (part = 'train') AS am, stddev_pop(v) FILTER (part = 'train') AS asd, avg(v) FILTER (part = 'test') AS bm, stddev_pop(v) FILTER (part = 'test') AS bsd FROM l GROUP BY 1, 2)"""


@query("fold_summary", B + f""", {RET}, {_FOLDS} SELECT k, metric, folds, {rs('am')} AS train_mean, {rs('asd')} AS train_std, {rs('bm')} AS test_mean, {rs('bsd')} AS test_std, {rs("CASE WHEN metric IN ('r2', 'direction_accuracy') THEN am - bm ELSE bm - am END")} AS overfitting FROM m""")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    """The next return fitted on each walk-forward fold's past, scored on both parts."""
    o = by_time()
    df = predictions.walk_forward(returns(spark, d).withColumn("y", F.lead("r").over(o)).select("k", "t", "r", "y"), o, train=100, test=20, gap=5)
    return rounded(predictions.fold_summary(predictions.fold_scores(df, "y", ["r"])))


@query("time_travel", B + f""", {RET}, f AS (SELECT k, t, i, close, close / nullif(lag(close, 24) OVER ({W}), 0) - 1 AS u, {full_sql('close / nullif(avg(close)', 'close', 24).replace('OVER w24 END', 'OVER w24, 0) - 1 END')} AS v, lead(close, 24) OVER ({W}) AS actual, lead(close, 24) OVER ({W}) / nullif(close, 0) - 1 AS y FROM r {windows(24)}),
  q AS (SELECT * FROM f WHERE u IS NOT NULL AND v IS NOT NULL AND y IS NOT NULL), s AS (SELECT a.k, a.t, a.close, a.u, a.v, a.actual, count(*) AS n, avg(q.u) AS mu, avg(q.v) AS mv, avg(q.y) AS my, var_pop(q.u) * count(*) + 0.001 AS uu, var_pop(q.v) * count(*) + 0.001 AS vv, covar_pop(q.u, q.v) * count(*) AS uv, covar_pop(q.u, q.y) * count(*) AS uy, covar_pop(q.v, q.y) * count(*) AS vy
    FROM f a JOIN q ON q.k = a.k AND q.i + 24 <= a.i WHERE a.i > 96 AND a.i % 10 = 0 AND a.actual IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) > 3),
  b AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS bu, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS bv FROM s), p AS (SELECT *, close * (1 + my + bu * (u - mu) + bv * (v - mv)) AS predicted FROM b)
SELECT k, t, n, {rs('predicted')} AS predicted, {rs('actual')} AS actual, {rs('abs(predicted - actual) / nullif(actual, 0)')} AS ape, (predicted > close) = (actual > close) AS direction_correct FROM p""")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    """At every tenth bar a ridge regression fitted on what was known then, against the close 24 bars on."""
    o = by_time()
    df = tb.hourly(spark, d).withColumns({"momentum": pct_change("close", o, 24), "level": ratio("close", sma("close", o, 24)) - 1})
    return rounded(predictions.fitted_at(df, "close", ["momentum", "level"], o, horizon=24, ridge=0.001, history=96, every=10))


@query("ratios_365", B + f""", {RET}, a AS (SELECT k, avg(r) * 365 AS ret, stddev_pop(r) * sqrt(365.0) AS vol, sqrt(avg(r * r) FILTER (r < 0)) * sqrt(365.0) AS down FROM r GROUP BY 1) SELECT k, {rs('ret')} AS annual_return, {rs('vol')} AS annual_vol, {rs('ret / nullif(vol, 0)')} AS sharpe, {rs('ret / nullif(down, 0)')} AS sortino FROM a""")
def ratios_365(spark: SparkSession, d: str) -> DataFrame:
    """Ratios by the other conventions: 365 periods a year, deviations with ddof 0, downside around zero."""
    r = F.col("r")
    year = F.sqrt(F.lit(365.0))
    a = returns(spark, d).groupBy("k").agg((F.avg(r) * 365).alias("annual_return"), (F.stddev_pop(r) * year).alias("annual_vol"), (F.sqrt(F.avg(F.when(r < 0, r * r))) * year).alias("down"))
    return rounded(a.select("k", "annual_return", "annual_vol", ratio("annual_return", "annual_vol").alias("sharpe"), ratio("annual_return", "down").alias("sortino")))


@query("valuation_ratios", B + f""", v AS (SELECT k, t, close * sum(volume) OVER o AS cap, sum(close * volume) OVER o AS realised, close * volume AS traded FROM bars WINDOW o AS ({W})) SELECT k, t, {rs('cap')} AS market_cap, {rs('cap / nullif(realised, 0)')} AS mvrv, {rs('cap / nullif(traded / 365, 0)')} AS nvt FROM v""")
def valuation_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Market value over realised value (each unit at the price it was traded at), and over traded value."""
    o, traded = by_time(), F.col("close") * F.col("volume")
    df = tb.hourly(spark, d).select("k", "t", (F.col("close") * running("sum", "volume", o)).alias("market_cap"), running("sum", traded, o).alias("realised"), traded.alias("traded"))
    return rounded(df.select("k", "t", "market_cap", ratio("market_cap", "realised").alias("mvrv"), ratio("market_cap", F.col("traded") / 365).alias("nvt")))


@query("key_sets", "SELECT user_id, true AS both FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT user_id, false FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase')")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Users in both of two sets, and in the first only."""
    of = lambda kind: tb.events(spark, d).where(F.col("event_type") == kind).select("user_id")
    a, b = of("click"), of("purchase")
    return a.intersect(b).withColumn("both", F.lit(True)).union(a.subtract(b).withColumn("both", F.lit(False)))


@query("weighted_index", f"SELECT date_trunc('hour', ts) AS t, {rs('''0.3 * coalesce(avg(value) FILTER (event_type = 'click'), 0) + 0.2 * coalesce(avg(value) FILTER (event_type = 'view'), 0) + 0.5 * coalesce(avg(value) FILTER (event_type = 'purchase'), 0)''')} AS score FROM events GROUP BY 1")
def weighted_index(spark: SparkSession, d: str) -> DataFrame:
    """Three sources' hourly means by fixed weights; a missing source counts nothing."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(kind)
    hours = tb.events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("t")).agg(mean("click"), mean("view"), mean("purchase"))
    return hours.select("t", r6(regimes.weighted_score({"click": 0.3, "view": 0.2, "purchase": 0.5})).alias("score"))


_HISTORY = f"{W} ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING"


@query("metric_history", B + f""", m AS (SELECT k, t, close, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM bars WINDOW w AS ({_HISTORY}))
SELECT k, t, {rs('CASE WHEN n >= 10 THEN (close - m) / nullif(s, 0) END')} AS z, coalesce(n >= 10 AND abs(close - m) > 2 * s, false) AS anomaly FROM m""")
def metric_history(spark: SparkSession, d: str) -> DataFrame:
    """Each value against the up to 1,000 before it."""
    frame = rows(by_time(), 1000, 1)
    df = tb.hourly(spark, d).withColumns({"n": F.count("close").over(frame), "m": F.avg("close").over(frame), "s": F.stddev_samp("close").over(frame)})
    gap = F.col("close") - F.col("m")
    return df.select("k", "t", r6(F.when(F.col("n") >= 10, ratio(gap, "s"))).alias("z"), F.coalesce((F.col("n") >= 10) & (F.abs(gap) > 2 * F.col("s")), F.lit(False)).alias("anomaly"))


#: The day's and the week's change of two past falls, and how severe they were.
FALLS = {"day_fall": ("day", -0.50, 1.0), "week_fall": ("week", -0.40, 0.8)}
_LIKE_FALL = {name: f"greatest(0, 1 - abs({part} - ({value})) / {abs(value)})" for name, (part, value, _) in FALLS.items()}


@query("risk_score", B + f""", o AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS other FROM events WHERE event_type = 'view' GROUP BY 1), j AS (SELECT k, bars.t, close, volume, last_value(other IGNORE NULLS) OVER (PARTITION BY k ORDER BY bars.t) AS other FROM bars LEFT JOIN o ON o.t = bars.t),
  b AS (SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r, ln(nullif(close, 0) / nullif(lag(close) OVER ({W}), 0)) AS lr, other - lag(other) OVER ({W}) AS od FROM j),
  c AS (SELECT *, lr - lag(lr) OVER ({W}) AS acc, close / nullif(lag(close, 5) OVER ({W}), 0) - 1 AS five, close / nullif(lag(close, 24) OVER ({W}), 0) - 1 AS day, close / nullif(lag(close, 168) OVER ({W}), 0) - 1 AS week, count(*) OVER ({W}) AS i FROM b),
  w AS (SELECT k, t, i, close, volume, five, od, r, day, week, avg(volume) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS v30, avg(close) OVER w5 AS m5, avg(close) OVER w10 AS m10, avg(close) OVER w20 AS m20, avg(abs(acc)) OVER w5 AS a5,
    avg(r) OVER w50 AS mr, stddev_samp(r) OVER w50 AS sr, corr(lr, od) OVER w10 AS cn, corr(lr, od) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 10 PRECEDING) AS co FROM c {windows(5, 10, 20, 50)}),
  p AS (SELECT k, t, 0.4 * least(coalesce(abs(five) / 0.05, 0), 1) + 0.25 * least(coalesce((volume / nullif(v30, 0) - 1) / 4, 0), 1) + 0.15 * CASE WHEN abs(od) > 3 THEN least(abs(od) / 10, 1) ELSE 0 END AS sudden,
    coalesce(CASE WHEN {_LIKE_FALL['day_fall']} >= coalesce({_LIKE_FALL['week_fall']}, 0) THEN {_LIKE_FALL['day_fall']} * 1.0 ELSE {_LIKE_FALL['week_fall']} * 0.8 END, 0) AS pattern,
    least(coalesce(abs((r - mr) / nullif(sr, 0)) / 6, 0), 1) AS anomaly, least(coalesce((abs(m5 / nullif(m20, 0) - 1) + abs(m10 / nullif(m20, 0) - 1) + 100 * a5) / 0.1, 0), 1) AS trend,
    least(coalesce(abs(CASE WHEN isnan(cn) THEN NULL ELSE cn END - CASE WHEN isnan(co) THEN NULL ELSE co END) / 0.5, 0), 1) AS correlation FROM w WHERE i > 30),
  x AS (SELECT *, 0.30 * sudden + 0.25 * pattern + 0.20 * anomaly + 0.15 * trend + 0.10 * correlation AS s FROM p)
SELECT k, t, {rs('sudden')} AS sudden, {rs('pattern')} AS pattern, {rs('anomaly')} AS anomaly, {rs('trend')} AS trend, {rs('correlation')} AS correlation, {rs('s')} AS score, CASE WHEN round(s, 9) >= 0.8 THEN 'CRITICAL' WHEN round(s, 9) >= 0.6 THEN 'WARNING' WHEN round(s, 9) >= 0.4 THEN 'INFO' ELSE 'LOW' END AS level FROM x""")
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    """All five components of the closes' risk by weight, the mean view of the hour in the macro series' place."""
    other = tb.events(spark, d).where("event_type = 'view'").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("other"))
    df = tb.hourly(spark, d).join(other, "t", "left").withColumn("other", F.last("other", ignorenulls=True).over(so_far(by_time())))
    return rounded(regimes.composite_risk(df, "close", "volume", "other", by_time(), FALLS))


#: Named patterns: change in percent and range in percent of a day.
PATTERNS = {"calm": (1.0, 50.0), "rally": (100.0, 150.0), "crash": (-60.0, 150.0)}


@query("named_patterns", B.replace("'hour'", "'day'") + f""", p AS (SELECT k, t, 100 * (close / open - 1) AS chg, 100 * (high - low) / open AS rng FROM bars), n(pattern, c, g) AS (VALUES {', '.join(f"('{n}', {a}, {b})" for n, (a, b) in PATTERNS.items())})
SELECT k, t, pattern, {rs('(greatest(0, 1 - abs(chg - c) / abs(c)) + greatest(0, 1 - abs(rng - g) / abs(g))) / 2')} AS similarity FROM p, n""")
def named_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Each day's likeness to every named pattern."""
    current = {"chg": 100 * (F.col("close") / F.col("open") - 1), "rng": 100 * (F.col("high") - F.col("low")) / F.col("open")}
    each = [F.struct(F.lit(n).alias("pattern"), regimes.pattern_similarity(current, {"chg": F.lit(a), "rng": F.lit(b)}).alias("similarity")) for n, (a, b) in PATTERNS.items()]
    return rounded(tb.daily(spark, d).select("k", "t", F.explode(F.array(*each)).alias("x")).select("k", "t", "x.*"))
