"""Bars, rolling windows and technical indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import c, full, log_return, pct_change, ratio, rolling, rolling_kurt, rolling_pct_rank, rolling_quantile, rolling_skew, rows, running, running_product, sma, so_far
from ..operators import ewm
from ..operators import indicators as ind
from ..sources import tables as tb
from ..sources.tables import by_time
from .registry import DAILY, HOURLY, W, query, r6, rounded

B = f"WITH {HOURLY} "


def full_sql(expr: str, x: str, k: int) -> str:
    return f"CASE WHEN count({x}) OVER w{k} = {k} THEN {expr} OVER w{k} END"


def windows(*ks: int) -> str:
    return "WINDOW " + ", ".join(f"w{k} AS ({W} ROWS {k - 1} PRECEDING)" for k in ks)


R6 = "round({} + 1e-9, 6) + 0.0"


def rs(expr: str) -> str:
    return R6.format(expr)


@query("bars_1h", B + "SELECT k, t, open, high, low, close, volume FROM bars")
def bars_1h(spark: SparkSession, d: str) -> DataFrame:
    return tb.hourly(spark, d)


@query("bars_1d_last", "SELECT event_type AS k, date_trunc('day', ts)::TIMESTAMP AS t, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1, 2")
def bars_1d_last(spark: SparkSession, d: str) -> DataFrame:
    return tb.daily(spark, d).select("k", "t", F.col("close").alias("last"))


@query("bars_mixed", f"SELECT date_trunc('hour', ts) AS t, {rs('avg(value)')} AS price, {rs('sum(value)')} AS volume, count(*) AS n FROM events GROUP BY 1")
def bars_mixed(spark: SparkSession, d: str) -> DataFrame:
    return tb.events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("t")).agg(r6(F.avg("value")).alias("price"), r6(F.sum("value")).alias("volume"), F.count("*").alias("n"))


@query("sma_std_bb", B + f""", m AS (SELECT k, t, close, {full_sql('avg(close)', 'close', 20)} AS mid, {full_sql('stddev_samp(close)', 'close', 20)} AS sd FROM bars {windows(20)})
SELECT k, t, {rs('mid')} AS bb_mid, {rs('mid + 2 * sd')} AS bb_upper, {rs('mid - 2 * sd')} AS bb_lower, {rs('(mid + 2 * sd - (mid - 2 * sd)) / nullif(mid, 0)')} AS bb_width,
  {rs('(close - (mid - 2 * sd)) / nullif(mid + 2 * sd - (mid - 2 * sd), 0)')} AS bb_position FROM m""")
def sma_std_bb(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", *[v.alias(n) for n, v in ind.bollinger("close", by_time()).items()]))


@query("rsi_cutler", B + f""", d AS (SELECT k, t, coalesce(close - lag(close) OVER ({W}), 0) AS d FROM bars),
  m AS (SELECT k, t, {full_sql('avg(greatest(d, 0))', 'd', 14)} AS g, {full_sql('avg(greatest(-d, 0))', 'd', 14)} AS l FROM d {windows(14)})
SELECT k, t, {rs('CASE WHEN l = 0 AND g = 0 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END')} AS rsi FROM m""")
def rsi_cutler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.rsi_cutler(tb.hourly(spark, d), by_time()).select("k", "t", "rsi"))


@query("rsi_stream", B + f""", d AS (SELECT k, t, close - lag(close) OVER ({W}) AS d FROM bars),
  m AS (SELECT k, t, count(d) OVER w14 AS n, avg(greatest(d, 0)) FILTER (d IS NOT NULL) OVER w14 AS g, avg(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER w14 AS l FROM d {windows(14)})
SELECT k, t, {rs('CASE WHEN n < 14 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END')} AS rsi FROM m""")
def rsi_stream(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.rsi_stream(tb.hourly(spark, d), by_time()).select("k", "t", "rsi"))


_EWM_SQL = """n AS (SELECT k, t, {x} AS x, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM {src})"""


def _adjusted(alpha: float, src: str = "n", x: str = "x") -> str:
    return f"(SELECT a.k, a.i, sum(b.{x} * pow(1 - {alpha!r}, a.i - b.i)) / sum(pow(1 - {alpha!r}, a.i - b.i)) AS e FROM {src} a JOIN {src} b ON a.k = b.k AND b.i <= a.i GROUP BY 1, 2)"


@query("ema_adjusted", B + ", " + _EWM_SQL.format(x="close", src="bars") + f""", e AS {_adjusted(2 / 21)}
SELECT k, t, {rs('e')} AS ema FROM n JOIN e USING (k, i)""")
def ema_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ewm.ewm(tb.hourly(spark, d).select("k", "t", "close"), "close", "ema", span=20).select("k", "t", "ema"))


_RECURSIVE = """e AS (SELECT a.k, a.i, sum(b.x * pow(1 - {a!r}, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE {a!r} END) AS e FROM n a JOIN n b ON a.k = b.k AND b.i <= a.i GROUP BY 1, 2)"""


@query("ema_recursive", B + ", " + _EWM_SQL.format(x="close", src="bars") + ", " + _RECURSIVE.format(a=2 / 21) + f" SELECT k, t, {rs('e')} AS ema FROM n JOIN e USING (k, i)")
def ema_recursive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ewm.ewm(tb.hourly(spark, d).select("k", "t", "close"), "close", "ema", span=20, adjust=False).select("k", "t", "ema"))


@query("ewm_com", B + ", " + _EWM_SQL.format(x="close", src="bars") + f", e AS {_adjusted(1 / 11)} SELECT k, t, {rs('e')} AS ema FROM n JOIN e USING (k, i)")
def ewm_com(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ewm.ewm(tb.hourly(spark, d).select("k", "t", "close"), "close", "ema", com=10).select("k", "t", "ema"))


@query("rsi_wilder", B + f""", dd AS (SELECT k, t, coalesce(close - lag(close) OVER ({W}), 0) AS d FROM bars),
  n AS (SELECT k, t, d, greatest(d, 0) AS g, greatest(-d, 0) AS l, row_number() OVER ({W}) AS i FROM dd),
  e AS (SELECT a.k, a.i, sum(b.g * z) AS g, sum(b.l * z) AS l FROM n a JOIN n b ON a.k = b.k AND b.i <= a.i,
    LATERAL (SELECT pow(13.0 / 14, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE 1.0 / 14 END AS z) GROUP BY 1, 2)
SELECT k, t, {rs('CASE WHEN i < 14 THEN NULL WHEN e.l = 0 AND e.g = 0 THEN NULL WHEN e.l = 0 THEN 100 ELSE 100 - 100 / (1 + e.g / nullif(e.l, 0)) END')} AS rsi FROM n JOIN e USING (k, i)""")
def rsi_wilder(spark: SparkSession, d: str) -> DataFrame:
    gain, loss = ind.gains_losses("close", by_time())
    df = tb.hourly(spark, d).select("k", "t", gain.alias("g"), loss.alias("l"), F.row_number().over(by_time()).alias("i"))
    df = ewm.ewm_many(df, [("g", "eg", 1 / 14, False), ("l", "el", 1 / 14, False)])
    value = F.when((F.col("i") < 14) | ((F.col("el") == 0) & (F.col("eg") == 0)), None).when(F.col("el") == 0, 100.0).otherwise(100 - 100 / (1 + ratio("eg", "el")))
    return df.select("k", "t", r6(value).alias("rsi"))


@query("macd", B + ", " + _EWM_SQL.format(x="close", src="bars") + f""", f AS {_adjusted(2 / 13)}, s AS {_adjusted(2 / 27)},
  m AS (SELECT f.k, f.i, f.e - s.e AS m FROM f JOIN s USING (k, i)), g AS {_adjusted(2 / 10, 'm', 'm')}
SELECT n.k, n.t, {rs('m.m')} AS macd, {rs('g.e')} AS macd_signal, {rs('m.m - g.e')} AS macd_hist FROM n JOIN m USING (k, i) JOIN g USING (k, i)""")
def macd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ewm.macd(tb.hourly(spark, d).select("k", "t", "close")).select("k", "t", "macd", "macd_signal", "macd_hist"))


_HL = f"CASE WHEN count(high) OVER w14 = 14 THEN max(high) OVER w14 END AS hh, CASE WHEN count(low) OVER w14 = 14 THEN min(low) OVER w14 END AS ll"


@query("stoch_williams", B + f""", m AS (SELECT k, t, close, {_HL} FROM bars {windows(14)}), s AS (SELECT k, t, 100 * (close - ll) / nullif(hh - ll, 0) AS sk, -100 * (hh - close) / nullif(hh - ll, 0) AS wr FROM m)
SELECT k, t, {rs('sk')} AS stoch_k, {rs('CASE WHEN count(sk) OVER w3 = 3 THEN avg(sk) OVER w3 END')} AS stoch_d, {rs('wr')} AS williams_r FROM s {windows(3)}""")
def stoch_williams(spark: SparkSession, d: str) -> DataFrame:
    k, williams = ind.stochastic(by_time())
    df = tb.hourly(spark, d).withColumn("stoch_k", k).withColumn("williams_r", williams)
    return rounded(df.select("k", "t", "stoch_k", sma("stoch_k", by_time(), 3).alias("stoch_d"), "williams_r"))


@query("atr_tr", B + f""", p AS (SELECT *, lag(close) OVER ({W}) AS pc FROM bars), r AS (SELECT k, t, close, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p)
SELECT k, t, {rs('tr')} AS tr, {rs(full_sql('avg(tr)', 'tr', 14))} AS atr, {rs('100 * ' + full_sql('avg(tr)', 'tr', 14) + ' / nullif(close, 0)')} AS natr FROM r {windows(14)}""")
def atr_tr(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("tr", ind.true_range(by_time())).withColumn("atr", sma("tr", by_time(), 14))
    return rounded(df.select("k", "t", "tr", "atr", (100 * ratio("atr", "close")).alias("natr")))


@query("cci", B + f""", p AS (SELECT k, t, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT k, t, tp, avg(tp) OVER w20 AS a, list(tp) OVER w20 AS l FROM p {windows(20)})
SELECT k, t, {rs('CASE WHEN len(l) = 20 THEN (tp - a) / nullif(0.015 * (list_sum(list_transform(l, lambda v: abs(v - a))) / len(l)), 0) END')} AS cci FROM m""")
def cci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.cci(tb.hourly(spark, d), by_time()).select("k", "t", "cci"))


@query("obv_pvt_vwap", B + f""", p AS (SELECT *, lag(close) OVER ({W}) AS pc FROM bars), q AS (SELECT *, coalesce(sign(close - pc) * volume, 0) AS ob, coalesce((close / nullif(pc, 0) - 1) * volume, 0) AS pv FROM p)
SELECT k, t, {rs(f'sum(ob) OVER ({W})')} AS obv, {rs(f'sum(pv) OVER ({W})')} AS pvt, {rs(f'sum(close * volume) OVER ({W}) / nullif(sum(volume) OVER ({W}), 0)')} AS vwap,
  {rs(f'sum((high + low + close) / 3 * volume) OVER ({W}) / nullif(sum(volume) OVER ({W}), 0)')} AS vwap_typical FROM q""")
def obv_pvt_vwap(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("ob", ind.obv(by_time())).withColumn("pv", ind.pvt(by_time()))
    return rounded(df.select(
        "k", "t", running("sum", "ob", by_time()).alias("obv"), running("sum", "pv", by_time()).alias("pvt"),
        ind.cumulative_vwap(by_time(), c("close")).alias("vwap"), ind.cumulative_vwap(by_time(), ind.typical_price()).alias("vwap_typical"),
    ))


@query("momentum_roc", B + "SELECT k, t, " + ", ".join(f"{rs(f'close - lag(close, {n}) OVER ({W})')} AS momentum_{n}, {rs(f'100 * (close / nullif(lag(close, {n}) OVER ({W}), 0) - 1)')} AS roc_{n}" for n in (5, 10, 24)) + " FROM bars")
def momentum_roc(spark: SparkSession, d: str) -> DataFrame:
    cols = {n: v for k in (5, 10, 24) for n, v in ind.momentum_columns(by_time(), k).items()}
    return rounded(tb.hourly(spark, d).select("k", "t", *[v.alias(n) for n, v in cols.items()]))


@query("price_position", B + "SELECT k, t, " + ", ".join(rs(f"(close - {full_sql('min(close)', 'close', n)}) / nullif({full_sql('max(close)', 'close', n)} - {full_sql('min(close)', 'close', n)}, 0)") + f" AS position_{n}" for n in (24, 168)) + f" FROM bars {windows(24, 168)}")
def price_position(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", *[ind.price_position("close", by_time(), n).alias(f"position_{n}") for n in (24, 168)]))


@query("ichimoku", B + f""", m AS (SELECT k, t, {', '.join(f"({full_sql('max(high)', 'high', n)} + {full_sql('min(low)', 'low', n)}) / 2 AS m{n}" for n in (9, 26, 52))} FROM bars {windows(9, 26, 52)})
SELECT k, t, {rs('m9')} AS conversion, {rs('m26')} AS base, {rs('(m9 + m26) / 2')} AS span_a, {rs('m52')} AS span_b FROM m""")
def ichimoku(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", *[v.alias(n) for n, v in ind.ichimoku(by_time()).items()]))


@query("volume_features", B + f"""SELECT k, t, {rs(full_sql('avg(volume)', 'volume', 20))} AS volume_sma, {rs('volume / nullif(' + full_sql('avg(volume)', 'volume', 20) + ', 0)')} AS volume_ratio,
  (volume > 2 * {full_sql('avg(volume)', 'volume', 20)})::DOUBLE AS volume_spike FROM bars {windows(20)}""")
def volume_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", *[v.alias(n) for n, v in ind.volume_features(by_time()).items()]))


@query("rolling_moments", B + f"SELECT k, t, {rs(full_sql('skewness(close)', 'close', 30))} AS skew, {rs(full_sql('kurtosis(close)', 'close', 30))} AS kurt, {rs(full_sql('var_pop(close)', 'close', 30))} AS var0, {rs(full_sql('sum(close)', 'close', 30))} AS total FROM bars {windows(30)}")
def rolling_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", rolling_skew("close", by_time(), 30).alias("skew"), rolling_kurt("close", by_time(), 30).alias("kurt"), rolling("var0", "close", by_time(), 30).alias("var0"), rolling("sum", "close", by_time(), 30).alias("total")))


@query("rolling_quantile", B + "SELECT k, t, " + ", ".join(f"{rs(full_sql(f'quantile_cont(close, {q})', 'close', 60))} AS q{int(q * 100):02d}" for q in (0.05, 0.5, 0.95)) + f" FROM bars {windows(60)}")
def rolling_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", *[rolling_quantile("close", by_time(), 60, q).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)]))


@query("rolling_pct_rank", B + f""", m AS (SELECT k, t, close, list(close) OVER w30 AS l FROM bars {windows(30)})
SELECT k, t, {rs('CASE WHEN len(l) = 30 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0) / 30 END')} AS pct_rank FROM m""")
def rolling_pct_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", rolling_pct_rank("close", by_time(), 30).alias("pct_rank")))


@query("rolling_trend", B + f""", n AS (SELECT *, row_number() OVER ({W})::DOUBLE AS i FROM bars)
SELECT k, t, {rs(full_sql('regr_slope(close, i)', 'close', 24))} AS slope, {rs(full_sql('regr_r2(close, i)', 'close', 24))} AS r2, {rs(full_sql('corr(close, i)', 'close', 24))} AS corr FROM n {windows(24)}""")
def rolling_trend(spark: SparkSession, d: str) -> DataFrame:
    df, f = tb.hourly(spark, d).withColumn("i", F.row_number().over(by_time()).cast("double")), rows(by_time(), 24)
    return rounded(df.select("k", "t", *[full(g(F.col("close"), F.col("i")).over(f), "close", f, 24).alias(n) for n, g in (("slope", F.regr_slope), ("r2", F.regr_r2), ("corr", F.corr))]))


@query("candles", B + f""", s AS (SELECT *, abs(close - open) AS body, high - low AS size, high - greatest(open, close) AS up, least(open, close) - low AS dn FROM bars)
SELECT k, t, {rs('body / nullif(size, 0)')} AS body_ratio, {rs('up / nullif(size, 0)')} AS upper_shadow, {rs('dn / nullif(size, 0)')} AS lower_shadow, coalesce((body / nullif(size, 0) < 0.1)::DOUBLE, 0) AS doji,
  (dn > 2 * body AND up < 0.5 * body AND body > 0)::DOUBLE AS hammer, (up > 2 * body AND dn < 0.5 * body AND body > 0)::DOUBLE AS shooting_star FROM s""")
def candles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", *[v.alias(n) for n, v in ind.candle_columns().items()]))


_PIVOT = "SELECT k, max(high) AS h, min(low) AS l, arg_max(close, t) AS c FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS rn FROM bars) WHERE rn <= 24 GROUP BY k"


@query("pivots", B + f", p AS ({_PIVOT}), q AS (SELECT *, (h + l + c) / 3 AS p FROM p) SELECT k, {rs('p')} AS pivot, {rs('2 * p - l')} AS r1, {rs('2 * p - h')} AS s1, {rs('p + (h - l)')} AS r2, {rs('p - (h - l)')} AS s2, {rs('h + 2 * (p - l)')} AS r3, {rs('l - 2 * (h - p)')} AS s3 FROM q")
def pivots(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    last = tb.hourly(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).where("rn <= 24")
    day = last.groupBy("k").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "t").alias("c"))
    return rounded(day.select("k", *[v.alias(n) for n, v in ind.pivot_levels(c("h"), c("l"), c("c")).items()]))


@query("fib_levels", B + f", p AS ({_PIVOT}) SELECT k, " + ", ".join(f"{rs(f'l + (h - l) * {f}')} AS fib_{int(f * 1000)}" for f in ind.FIBONACCI) + " FROM p")
def fib_levels(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    last = tb.hourly(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).where("rn <= 24")
    day = last.groupBy("k").agg(F.max("high").alias("h"), F.min("low").alias("l"))
    return rounded(day.select("k", *[v.alias(n) for n, v in ind.fibonacci_levels(c("h"), c("l")).items()]))


@query("calendar_features", B + f"""SELECT k, t, hour(t)::INTEGER AS hour, (isodow(t) - 1)::INTEGER AS dow, month(t)::INTEGER AS month, quarter(t)::INTEGER AS quarter,
  {rs('sin(2 * pi() * hour(t) / 24)')} AS hour_sin, {rs('cos(2 * pi() * hour(t) / 24)')} AS hour_cos, {rs('sin(2 * pi() * (isodow(t) - 1) / 7)')} AS dow_sin, {rs('cos(2 * pi() * (isodow(t) - 1) / 7)')} AS dow_cos,
  {rs('sin(2 * pi() * month(t) / 12)')} AS month_sin, {rs('cos(2 * pi() * month(t) / 12)')} AS month_cos, (isodow(t) >= 6)::INTEGER AS is_weekend, (hour(t) BETWEEN 9 AND 16)::INTEGER AS trading_hours,
  CASE WHEN hour(t) < 8 THEN 'asia' WHEN hour(t) < 16 THEN 'europe' ELSE 'america' END AS session FROM bars""")
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", *[v.alias(n) for n, v in ind.calendar().items()]))


@query("returns_lags_targets", B + f"""SELECT k, t, {rs(f'close / nullif(lag(close) OVER ({W}), 0) - 1')} AS ret_1, {rs(f'close / nullif(lag(close, 24) OVER ({W}), 0) - 1')} AS ret_24, {rs(f'ln(close / nullif(lag(close) OVER ({W}), 0))')} AS log_ret,
  lag(close) OVER ({W}) AS lag_1, lag(close, 24) OVER ({W}) AS lag_24, lead(close, 24) OVER ({W}) AS target_24, {rs(f'lead(close, 24) OVER ({W}) / nullif(close, 0) - 1')} AS target_ret,
  coalesce(lead(close, 24) OVER ({W}) IS NOT NULL AND lag(close, 24) OVER ({W}) IS NOT NULL, false) AS valid FROM bars""")
def returns_lags_targets(spark: SparkSession, d: str) -> DataFrame:
    ahead, behind = F.lead("close", 24).over(by_time()), F.lag("close", 24).over(by_time())
    return tb.hourly(spark, d).select(
        "k", "t", r6(pct_change("close", by_time())).alias("ret_1"), r6(pct_change("close", by_time(), 24)).alias("ret_24"), r6(log_return("close", by_time())).alias("log_ret"),
        F.lag("close").over(by_time()).alias("lag_1"), behind.alias("lag_24"), ahead.alias("target_24"), r6(ratio(ahead, "close") - 1).alias("target_ret"), (ahead.isNotNull() & behind.isNotNull()).alias("valid"),
    )


D = f"WITH {DAILY} "


@query("equity_curve", D + f""", r AS (SELECT k, t, (close / nullif(lag(close) OVER ({W}), 0) - 1) / 100 AS r FROM bars), e AS (SELECT k, t, exp(sum(ln(1 + coalesce(r, 0))) OVER ({W})) AS e FROM r)
SELECT k, t, {rs('e')} AS equity, {rs(f'max(e) OVER ({W})')} AS peak, {rs(f'e / max(e) OVER ({W}) - 1')} AS drawdown FROM e""")
def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    df = tb.daily(spark, d).withColumn("r", pct_change("close", by_time()) / 100)
    df = df.withColumn("equity", running_product("r", by_time())).withColumn("peak", running("max", "equity", by_time()))
    return rounded(df.select("k", "t", "equity", "peak", (F.col("equity") / F.col("peak") - 1).alias("drawdown")))


@query("crossovers", B + f""", m AS (SELECT k, t, sign({full_sql('avg(close)', 'close', 12)} - {full_sql('avg(close)', 'close', 48)}) AS s FROM bars {windows(12, 48)}),
  x AS (SELECT k, t, (s - lag(s) OVER ({W})) / 2 AS cross_ FROM m) SELECT k, t, {rs('cross_')} AS crossing FROM x WHERE cross_ <> 0""")
def crossovers(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("a", sma("close", by_time(), 12)).withColumn("b", sma("close", by_time(), 48))
    return rounded(df.withColumn("crossing", ind.crossover(c("a"), c("b"), by_time())).where("crossing <> 0").select("k", "t", "crossing"))


@query("gradient_divergence", B + f""", g AS (SELECT k, t, close, volume, CASE WHEN lag(close) OVER ({W}) IS NULL THEN lead(close) OVER ({W}) - close WHEN lead(close) OVER ({W}) IS NULL THEN close - lag(close) OVER ({W}) ELSE (lead(close) OVER ({W}) - lag(close) OVER ({W})) / 2 END AS gc,
  CASE WHEN lag(volume) OVER ({W}) IS NULL THEN lead(volume) OVER ({W}) - volume WHEN lead(volume) OVER ({W}) IS NULL THEN volume - lag(volume) OVER ({W}) ELSE (lead(volume) OVER ({W}) - lag(volume) OVER ({W})) / 2 END AS gv FROM bars)
SELECT k, t, {rs('gc')} AS gradient, (sign(gc) <> sign(gv))::DOUBLE AS divergence FROM g""")
def gradient_divergence(spark: SparkSession, d: str) -> DataFrame:
    def gradient(x):
        a, b = F.lag(x).over(by_time()), F.lead(x).over(by_time())
        return F.when(a.isNull(), b - c(x)).when(b.isNull(), c(x) - a).otherwise((b - a) / 2)

    df = tb.hourly(spark, d).withColumn("gradient", gradient("close")).withColumn("gv", gradient("volume"))
    return rounded(df.select("k", "t", "gradient", (F.signum("gradient") != F.signum("gv")).cast("double").alias("divergence")))


@query("centred_rolling", B + f"""SELECT k, t, {rs(f'CASE WHEN count(close) OVER c24 = 24 THEN avg(close) OVER c24 END')} AS mid, {rs('CASE WHEN count(close) OVER c24 = 24 THEN stddev_samp(close) OVER c24 END')} AS dev, {rs('avg(close) OVER h12')} AS clamped
FROM bars WINDOW c24 AS ({W} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), h12 AS ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)""")
def centred_rolling(spark: SparkSession, d: str) -> DataFrame:
    f, h = by_time().rowsBetween(-12, 11), by_time().rowsBetween(-12, 12)
    return rounded(tb.hourly(spark, d).select("k", "t", full(F.avg("close").over(f), "close", f, 24).alias("mid"), full(F.stddev_samp("close").over(f), "close", f, 24).alias("dev"), F.avg("close").over(h).alias("clamped")))


@query("streak_counts", B + f""", s AS (SELECT k, t, (close > lag(close) OVER ({W}))::DOUBLE AS up, (close < lag(close) OVER ({W}))::DOUBLE AS dn FROM bars)
SELECT k, t, {rs(full_sql('sum(up)', 'up', 10))} AS up_10, {rs(full_sql('sum(dn)', 'dn', 10))} AS down_10, {rs(full_sql('sum(up)', 'up', 10) + ' / (' + full_sql('sum(dn)', 'dn', 10) + ' + 1)')} AS up_down FROM s {windows(10)}""")
def streak_counts(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("close").over(by_time())
    df = tb.hourly(spark, d).withColumn("up", (F.col("close") > before).cast("double")).withColumn("dn", (F.col("close") < before).cast("double"))
    up, dn = rolling("sum", "up", by_time(), 10), rolling("sum", "dn", by_time(), 10)
    return rounded(df.select("k", "t", up.alias("up_10"), dn.alias("down_10"), (up / (dn + 1)).alias("up_down")))


@query("vol_clustering", B + f""", r AS (SELECT k, t, abs(ln(close / nullif(lag(close) OVER ({W}), 0))) AS a FROM bars) SELECT k, t, {rs('a / nullif(' + full_sql('stddev_samp(a)', 'a', 24) + ', 0)')} AS clustering FROM r {windows(24)}""")
def vol_clustering(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("a", F.abs(log_return("close", by_time())))
    return rounded(df.select("k", "t", ratio("a", rolling("std", "a", by_time(), 24)).alias("clustering")))


@query("riskmetrics_vol", B + f""", r AS (SELECT k, t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars), n AS (SELECT *, row_number() OVER ({W}) AS i FROM r WHERE r IS NOT NULL),
  s AS (SELECT k, var_samp(r) AS v0 FROM n WHERE i <= 20 GROUP BY k),
  e AS (SELECT a.k, a.i, sum(CASE WHEN b.i > 20 THEN b.r * b.r * 0.06 * pow(0.94, a.i - b.i) ELSE 0 END) AS e FROM n a JOIN n b ON a.k = b.k AND b.i <= a.i GROUP BY 1, 2)
SELECT n.k, n.t, {rs('CASE WHEN n.i >= 20 THEN v0 * pow(0.94, n.i - 20) + e.e END')} AS variance FROM n JOIN e USING (k, i) JOIN s ON s.k = n.k""")
def riskmetrics_vol(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", "t", pct_change("close", by_time()).alias("r")).where("r IS NOT NULL")
    return rounded(ewm.riskmetrics_variance(df, "r", "variance").select("k", "t", "variance"))


@query("garch_fixed", B + f""", r AS (SELECT k, t, coalesce(ln(close / nullif(lag(close) OVER ({W}), 0)), 0) AS r FROM bars), n AS (SELECT *, row_number() OVER ({W}) AS i FROM r),
  e AS (SELECT a.k, a.i, coalesce(sum((1e-6 + 0.1 * b.r * b.r) * pow(0.85, a.i - 1 - b.i)), 0) + 1e-4 * pow(0.85, a.i - 1) AS h FROM n a LEFT JOIN n b ON a.k = b.k AND b.i < a.i GROUP BY 1, 2) SELECT k, t, {rs('h')} AS variance FROM n JOIN e USING (k, i)""")
def garch_fixed(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", "t", F.coalesce(log_return("close", by_time()), F.lit(0.0)).alias("r"))
    return rounded(ewm.garch_variance(df, "r", "variance").select("k", "t", "variance"))


@query("rolling_min_periods", B + f"SELECT k, t, {rs(f'avg(close) OVER ({W} ROWS 9 PRECEDING)')} AS mean_10, {rs(f'max(close) OVER ({W})')} AS peak FROM bars")
def rolling_min_periods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", F.avg("close").over(rows(by_time(), 10)).alias("mean_10"), F.max("close").over(so_far(by_time())).alias("peak")))
