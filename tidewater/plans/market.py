"""Microstructure, transfers, derivatives, risk and robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pct_change
from ..operators import market, risk, robust
from ..sources import tables as tb
from ..sources.tables import by_time
from .indicators import B, D, rs
from .registry import TRADES, WHALES, W, query, rounded

T, H = f"WITH {TRADES} ", f"WITH {WHALES} "
_BUCKET = "CASE WHEN size < 10 THEN 'retail' WHEN size < 25 THEN 'small' WHEN size < 40 THEN 'medium' ELSE 'whale' END"


@query("vwap_buckets", T + f"SELECT k, {_BUCKET} AS bucket, count(*) AS n, {rs('sum(size)')} AS volume, {rs('sum(price * size) / greatest(sum(size), 1)')} AS vwap, {rs('''sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) / sum(size)''')} AS buy_ratio, {rs('sum(size) / sum(sum(size)) OVER (PARTITION BY k)')} AS share FROM trades GROUP BY 1, 2")
def vwap_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.size_buckets(tb.trades(spark, d), ["k"]))


_BUY, _SELL = "sum(CASE WHEN side = 'buy' THEN size ELSE 0 END)", "sum(CASE WHEN side = 'sell' THEN size ELSE 0 END)"


@query("trade_flow", T + f"SELECT date_trunc('month', t)::TIMESTAMP AS m, {rs(_BUY)} AS buy_volume, {rs(_SELL)} AS sell_volume, {rs(f'{_BUY} - {_SELL}')} AS net, {rs(f'{_BUY} / greatest({_BUY} + {_SELL}, 1)')} AS buy_ratio, {rs('avg((NOT is_maker)::INT)')} AS aggressive, {rs('''sum(CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END * size * size) / sum(size * size)''')} AS weighted_direction FROM trades GROUP BY 1")
def trade_flow(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.flow(tb.trades(spark, d).withColumn("m", F.date_trunc("month", "t")), ["m"]))


@query("book_impact", T + f""", lv AS (SELECT l_partkey, price, sum(size) AS size FROM trades GROUP BY 1, 2), f AS (SELECT l_partkey, price, least(greatest(100 - (sum(size) OVER (PARTITION BY l_partkey ORDER BY price ROWS UNBOUNDED PRECEDING) - size), 0), size) AS fill FROM lv),
  g AS (SELECT l_partkey, sum(fill) AS filled, CASE WHEN sum(fill) >= 100 THEN sum(fill * price) / 100 END AS a, min(price) AS best FROM f GROUP BY 1) SELECT l_partkey, {rs('filled')} AS filled, {rs('a')} AS average, {rs('a / best - 1')} AS impact FROM g""")
def book_impact(spark: SparkSession, d: str) -> DataFrame:
    levels = tb.trades(spark, d).groupBy("l_partkey", "price").agg(F.sum("size").alias("size"))
    return rounded(market.walk_book(levels, 100.0, "l_partkey"))


@query("whale_flows", H + f", n AS (SELECT max(t) AS now FROM whales) SELECT exchange, " + ", ".join(f"{rs(f'''sum(CASE WHEN t > now - INTERVAL {h} HOUR AND direction = '{x}' THEN amount ELSE 0 END)''')} AS {x}_{n}" for n, h in (("7d", 168), ("30d", 720)) for x in ("inflow", "outflow")) + f""",
  {rs('''least(greatest((sum(CASE WHEN direction = 'outflow' THEN amount ELSE 0 END) - sum(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END)) / nullif(sum(CASE WHEN direction <> 'internal' THEN amount ELSE 0 END), 0), -1), 1)''')} AS accumulation FROM whales, n GROUP BY exchange""")
def whale_flows(spark: SparkSession, d: str) -> DataFrame:
    df = tb.whales(spark, d)
    now = df.agg(F.max("t").alias("now")).collect()[0]["now"]  # one timestamp
    return rounded(market.whale_flows(df, F.lit(now), {"7d": 168, "30d": 720}))


@query("unique_addresses", H + ", a AS (SELECT exchange, unnest([address::VARCHAR, 'x' || (seq % 50)]) AS a FROM whales) SELECT exchange, count(DISTINCT a) AS addresses FROM a GROUP BY 1")
def unique_addresses(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(F.col("address").cast("string"), F.concat(F.lit("x"), F.col("seq") % 50))
    return tb.whales(spark, d).select("exchange", F.explode(both).alias("a")).groupBy("exchange").agg(F.countDistinct("a").alias("addresses"))


@query("hhi", H + f", s AS (SELECT exchange, address, sum(amount) AS s FROM whales GROUP BY 1, 2) SELECT exchange, {rs('1000 * sum(s * s) / (sum(s) * sum(s))')} AS hhi, count(*) AS members FROM s GROUP BY 1")
def hhi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.herfindahl(tb.whales(spark, d), "exchange", "address", "amount").withColumn("hhi", F.col("hhi") * 1000))


_FUND = "f AS (SELECT event_type AS v, avg(value) / 1e4 AS r FROM events GROUP BY 1)"


@query("funding_arbitrage", f"WITH {_FUND} SELECT a.v AS a, b.v AS b, {rs('a.r - b.r')} AS spread FROM f a JOIN f b ON a.v < b.v WHERE abs(a.r - b.r) > 0.00001")
def funding_arbitrage(spark: SparkSession, d: str) -> DataFrame:
    venues = tb.events(spark, d).groupBy(F.col("event_type").alias("v")).agg((F.avg("value") / 1e4).alias("r"))
    return rounded(market.pairwise_spread(venues, "v", "r", 1e-5))


@query("funding_summary", f"SELECT event_type AS venue, {rs('100 * avg(value)')} AS mean_pct, {rs('100 * stddev_pop(value)')} AS std_pct, {rs('avg(value) * 1095')} AS annual FROM events GROUP BY 1")
def funding_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.events(spark, d).groupBy(F.col("event_type").alias("venue")).agg((100 * F.avg("value")).alias("mean_pct"), (100 * F.stddev_pop("value")).alias("std_pct"), (F.avg("value") * 1095).alias("annual")))


@query("iv_skew", f"SELECT l_shipdate::TIMESTAMP AS t, {rs('''avg(l_discount) FILTER (l_returnflag = 'R' AND l_quantity < 20)''')} AS put_iv, {rs('''avg(l_discount) FILTER (l_returnflag = 'A' AND l_quantity > 30)''')} AS call_iv, {rs('''avg(l_discount) FILTER (l_returnflag = 'R' AND l_quantity < 20) - avg(l_discount) FILTER (l_returnflag = 'A' AND l_quantity > 30)''')} AS skew FROM lineitem GROUP BY 1")
def iv_skew(spark: SparkSession, d: str) -> DataFrame:
    put = F.avg(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 20), F.col("l_discount")))
    call = F.avg(F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 30), F.col("l_discount")))
    return rounded(tb.table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("timestamp").alias("t")).agg(put.alias("put_iv"), call.alias("call_iv"), (put - call).alias("skew")))


@query("venue_arbitrage", f"""WITH q AS (SELECT s_nationkey AS v, min(l_extendedprice / l_quantity) AS ask, max(l_extendedprice / l_quantity) * 0.55 AS bid FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
  p AS (SELECT a.v AS buy, b.v AS sell, 10000 * (b.bid - a.ask) / a.ask AS bps FROM q a JOIN q b ON a.v <> b.v WHERE b.bid > a.ask), n AS (SELECT count(*) AS n FROM q)
SELECT count(*) AS found, {rs('max(bps) - 20')} AS best_net_bps, {rs('1 - count(*) / any_value(n * (n - 1))')} AS efficiency FROM p, n""")
def venue_arbitrage(spark: SparkSession, d: str) -> DataFrame:
    li = tb.table(spark, d, "lineitem").join(tb.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    quotes = li.groupBy(F.col("s_nationkey").alias("v")).agg(F.min(price).alias("ask"), (F.max(price) * 0.55).alias("bid")).withColumn("j", F.lit(1))
    n = quotes.count()  # venues are a dimension
    a, b = quotes.select(F.col("v").alias("buy"), "ask", "j"), quotes.select(F.col("v").alias("sell"), "bid", "j")
    pairs = a.join(b, "j").where("buy <> sell AND bid > ask").withColumn("bps", 10000 * (F.col("bid") - F.col("ask")) / F.col("ask"))
    return rounded(pairs.agg(F.count("*").alias("found"), (F.max("bps") - 20).alias("best_net_bps"), (1 - F.count("*") / (n * (n - 1))).alias("efficiency")))


# -- risk -------------------------------------------------------------------------------
_R = f", r AS (SELECT k, t, (close / nullif(lag(close) OVER ({W}), 0) - 1) / 100 AS r FROM bars QUALIFY r IS NOT NULL) "


def returns(spark: SparkSession, d: str) -> DataFrame:
    return tb.daily(spark, d).select("k", "t", (pct_change("close", by_time()) / 100).alias("r")).where("r IS NOT NULL")


@query("var_cvar", D + _R + ", q AS (SELECT k, avg(r) AS mu, stddev_samp(r) AS sd, " + ", ".join(f"quantile_cont(r, {round(1 - p / 100, 2)}) AS v{p}" for p in (90, 95, 99)) + " FROM r GROUP BY 1) SELECT r.k, " + ", ".join(f"{rs(f'any_value(v{p})')} AS var_{p}, {rs(f'avg(r) FILTER (r <= v{p} + 1e-15)')} AS cvar_{p}, {rs(f'any_value(mu - {z!r} * sd)')} AS normal_var_{p}, {rs(f'any_value(mu - sd * {den / (1 - p / 100)!r})')} AS normal_cvar_{p}" for p, (z, den) in risk.NORMAL.items()) + " FROM r JOIN q USING (k) GROUP BY r.k")
def var_cvar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.var_cvar(returns(spark, d), "r", ["k"]))


@query("ratios", D + _R + f"""SELECT k, {rs('avg(r) * 252')} AS annual_return, {rs('stddev_samp(r) * sqrt(252)')} AS annual_vol, {rs('avg(r) / nullif(stddev_samp(r), 0) * sqrt(252)')} AS sharpe, {rs('avg(r) / nullif(sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(r)), 0) * sqrt(252)')} AS sortino,
  {rs('sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0)')} AS omega, {rs('sum(r) / nullif(sum(greatest(-r, 0)), 0)')} AS gain_to_pain, {rs('avg((r > 0)::INT)')} AS hit_ratio, {rs('count(r) / 6.0 * (pow(skewness_pop(r), 2) + pow(((kurtosis(r) * (count(r) - 2) * (count(r) - 3) / (count(r) - 1) - 6) / (count(r) + 1)), 2) / 4)')} AS jarque_bera, {rs('skewness(r)')} AS skew, {rs('kurtosis(r)')} AS kurt FROM r GROUP BY k""".replace("skewness_pop(r)", "(skewness(r) * (count(r) - 2) / sqrt(count(r) * (count(r) - 1)))"))
def ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.ratios(returns(spark, d), "r", ["k"]))


@query("tail_stats", D + _R + f", q AS (SELECT k, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.95) AS p95, quantile_cont(-r, 0.9) AS th FROM r GROUP BY 1) SELECT r.k, {rs('any_value(abs(p95) / nullif(abs(p05), 0))')} AS tail_ratio, {rs('avg(r) FILTER (r <= p05 + 1e-15)')} AS shortfall, {rs('1 / nullif(avg(ln(-r / th)) FILTER (-r > th AND th > 0), 0)')} AS hill FROM r JOIN q USING (k) GROUP BY r.k")
def tail_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.tail_stats(returns(spark, d), "r", ["k"]))


@query("rolling_sharpe", B + _R + "SELECT k, t, " + ", ".join(f"{rs(f'CASE WHEN count(r) OVER w{k} = {k} THEN avg(r) OVER w{k} / nullif(stddev_samp(r) OVER w{k}, 0) END')} AS sharpe_{k}, {rs(f'CASE WHEN count(r) OVER w{k} = {k} THEN stddev_samp(r) OVER w{k} END')} AS vol_{k}, {rs(f'CASE WHEN count(r) OVER w{k} = {k} THEN quantile_cont(r, 0.05) OVER w{k} END')} AS var_{k}" for k in (30, 60)) + " FROM r WINDOW " + ", ".join(f"w{k} AS ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (30, 60)))
def rolling_sharpe(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", "t", (pct_change("close", by_time()) / 100).alias("r")).where("r IS NOT NULL")
    cols = {n: v for k in (30, 60) for n, v in risk.rolling_risk("r", by_time(), k).items()}
    return rounded(df.select("k", "t", *[v.alias(n) for n, v in cols.items()]))


@query("coskew", B + _R + f", l AS (SELECT k, r, lag(r) OVER ({W}) AS p FROM r QUALIFY p IS NOT NULL), m AS (SELECT k, avg(r) AS a, avg(p) AS b, stddev_pop(r) AS s, stddev_pop(p) AS u FROM l GROUP BY 1) SELECT l.k, {rs('avg(pow((r - a) / s, 2) * (p - b) / u)')} AS coskew, {rs('avg(pow((r - a) / s, 3) * (p - b) / u)')} AS cokurt FROM l JOIN m USING (k) GROUP BY l.k")
def coskew(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", "t", (pct_change("close", by_time()) / 100).alias("r")).where("r IS NOT NULL")
    return rounded(risk.co_moments(df.withColumn("p", F.lag("r").over(by_time())), "r", "p", ["k"]))


@query("regression_metrics", B + f", p AS (SELECT k, close AS y, avg(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM bars QUALIFY p IS NOT NULL) SELECT k, {rs('avg((y - p) * (y - p))')} AS mse, {rs('avg(abs(y - p))')} AS mae, {rs('sqrt(avg((y - p) * (y - p)))')} AS rmse, {rs('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2, {rs('100 * avg(abs(y - p) / nullif(abs(y), 0))')} AS mape, {rs('max(abs(y - p))')} AS max_error FROM p GROUP BY k")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("p", F.avg("close").over(by_time().rowsBetween(-5, -1))).where("p IS NOT NULL")
    return rounded(risk.regression_metrics(df, "close", "p", ["k"]))


# -- robust statistics ------------------------------------------------------------------
@query("robust_means", f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM events GROUP BY 1), w AS (SELECT event_type, avg(least(greatest(value, a), b)) AS wm FROM events JOIN q USING (event_type) GROUP BY 1),
  r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), t AS (SELECT event_type, avg(value) AS tm FROM r WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY 1)
SELECT event_type, {rs('tm')} AS trimmed_mean, {rs('wm')} AS winsorised_mean FROM t JOIN w USING (event_type)""")
def robust_means(spark: SparkSession, d: str) -> DataFrame:
    ev = tb.events(spark, d)
    return rounded(robust.trimmed_mean(ev, "value", ["event_type"]).join(robust.winsorised_mean(ev, "value", ["event_type"]), "event_type"))


def _huber_sql(rounds: int) -> str:
    ctes = ["e0 AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1)", "sp AS (SELECT event_type, greatest(median(abs(value - m)) / 0.6745, 1e-9) AS s FROM events JOIN e0 USING (event_type) GROUP BY 1)"]
    for i in range(rounds):
        w = "least(1.0, 1.345 / greatest(abs(value - m) / s, 1e-12))"
        ctes.append(f"e{i + 1} AS (SELECT event_type, sum({w} * value) / sum({w}) AS m FROM events JOIN e{i} USING (event_type) JOIN sp USING (event_type) GROUP BY 1)")
    return f"WITH {', '.join(ctes)} SELECT event_type, {rs('m')} AS huber_mean FROM e{rounds}"


@query("huber_mean", _huber_sql(4))
def huber_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robust.huber_mean(tb.events(spark, d).select("event_type", "value"), "value", ["event_type"], rounds=4))


@query("weighted_median", "WITH s AS (SELECT l_returnflag AS k, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT k, x, sum(w) OVER (PARTITION BY k ORDER BY x) AS c, sum(w) OVER (PARTITION BY k) AS t FROM s) SELECT k, min(x) AS weighted_median FROM c WHERE c >= t / 2 GROUP BY k")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    li = tb.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"))
    return robust.weighted_median(li, "x", "w", ["k"])


@query("weighted_mean", f"SELECT l_returnflag AS k, {rs('sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity), 0.001)')} AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(robust.weighted_mean("l_extendedprice", "l_quantity").alias("mean")))


@query("histogram_entropy", f"""WITH e AS (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY 1), c AS (SELECT event_type, least(floor((value - a) / nullif(b - a, 0) * 20), 19) AS i, count(*) AS n FROM events JOIN e USING (event_type) GROUP BY 1, 2), p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
SELECT event_type, {rs('-sum(p * log2(p))')} AS entropy FROM p GROUP BY 1""")
def histogram_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robust.histogram_entropy(tb.events(spark, d), "value", ["event_type"]))


@query("permutation_entropy", B + f""", l AS (SELECT k, (lag(close, 2) OVER ({W}) <= lag(close) OVER ({W}))::INT || '' || (lag(close) OVER ({W}) <= close)::INT || '' || (lag(close, 2) OVER ({W}) <= close)::INT AS code FROM bars), c AS (SELECT k, code, count(*) AS n FROM l WHERE code IS NOT NULL GROUP BY 1, 2), p AS (SELECT k, n / sum(n) OVER (PARTITION BY k) AS p FROM c)
SELECT k, {rs('-sum(p * log2(p)) / log2(6)')} AS permutation_entropy FROM p GROUP BY k""")
def permutation_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robust.permutation_entropy(tb.hourly(spark, d), "close", by_time()))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return robust.bootstrap_means(tb.events(spark, d), "value", "event_type", "event_id")
