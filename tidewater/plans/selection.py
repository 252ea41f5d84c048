"""Book depth and market quality, stress, feature selection, interactions and series made from series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment, correlation, feature_sets, market
from ..sources import tables as tb
from ..sources.tables import by_time
from .indicators import B, rs
from .registry import ORACLE_SQL, QUERIES, W, query, rounded

_LEVELS = "l AS (SELECT l_suppkey, l_extendedprice / l_quantity AS p, l_quantity AS q, l_returnflag = 'N' AS ask FROM lineitem)"
_SHARE = lambda b, a: f"({b} - {a}) / greatest({b} + {a}, 1)"
_TOTAL = lambda keep: f"coalesce(sum(q) FILTER ({keep}), 0)"
_BOOKS = f"""WITH {_LEVELS}, e AS (SELECT *, max(p) FILTER (NOT ask) OVER s AS bid, min(p) FILTER (ask) OVER s AS best, row_number() OVER (PARTITION BY l_suppkey, ask ORDER BY CASE WHEN ask THEN p ELSE -p END, q DESC) AS r FROM l WINDOW s AS (PARTITION BY l_suppkey)),
  m AS (SELECT *, (bid + best) / 2 AS mid FROM e WHERE bid IS NOT NULL AND best IS NOT NULL),
  d AS (SELECT l_suppkey, bid, best, mid, {', '.join(f"{_TOTAL(f'NOT ask AND p >= bid - mid * {x / 100}::DOUBLE')} AS b{i}, {_TOTAL(f'ask AND p <= best + mid * {x / 100}::DOUBLE')} AS a{i}" for i, x in enumerate(market.DEPTHS))},
    {_SHARE(_TOTAL('NOT ask AND r <= 20'), _TOTAL('ask AND r <= 20'))} AS v, sum(q) AS volume, 1 / (1 + stddev_samp(p) / avg(p)) AS stability FROM m GROUP BY 1, 2, 3, 4)"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as the levels of one book for each supplier."""
    return tb.trades(spark, d).select("l_suppkey", "price", "size", (F.col("side") == "buy").alias("ask"))


@query("book_depth", _BOOKS + f" SELECT l_suppkey, {', '.join(f'{rs(f'b{i}')} AS bid_{i}, {rs(f'a{i}')} AS ask_{i}, {rs(_SHARE(f'b{i}', f'a{i}'))} AS imbalance_{i}' for i in range(len(market.DEPTHS)))}, {rs('v')} AS volume_imbalance, {rs('least(1, (b2 + a2) / 100)')} AS liquidity FROM d")
def book_depth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.book_depth(_levels(spark, d), "l_suppkey").drop("best_bid", "best_ask", "mid"))


@query("market_quality", _BOOKS + f""" SELECT l_suppkey, {rs('0.3 * least(1, (b2 + a2) / 100) + 0.25 * (greatest(0, 1 - (best - bid) / mid * 10000 / 50) + least(1, volume / 1000)) / 2 + 0.25 * coalesce(stability, 0) + 0.2 * (1 - abs(v))')} AS quality FROM d""")
def market_quality(spark: SparkSession, d: str) -> DataFrame:
    """Steady prices stand for the makers' stability, a balanced book for the absorption of shocks."""
    levels = _levels(spark, d)
    traded = levels.groupBy(F.col("l_suppkey").alias("b")).agg(F.sum("size").alias("volume"), (1 / (1 + F.stddev_samp("price") / F.avg("price"))).alias("stability"))
    books = market.book_depth(levels, "l_suppkey").join(traded, F.col("l_suppkey").eqNullSafe(F.col("b")))
    bps = (F.col("best_ask") - F.col("best_bid")) / F.col("mid") * 10_000
    score = market.market_quality(F.col("liquidity"), bps, F.col("volume"), F.col("stability"), 1 - F.abs("volume_imbalance"))
    return rounded(books.select("l_suppkey", score.alias("quality")))


_CORRS = " + ".join(f"CASE WHEN abs(corr(close, {x})) > 0.5 THEN 1 ELSE 0 END" for x in ("open", "high", "low", "volume"))
_BIAS = lambda x, b: f"CASE WHEN {x} > {b} THEN 'BULLISH' WHEN {x} < -{b} THEN 'BEARISH' ELSE 'NEUTRAL' END"


@query("macro_stress", B + f""", s AS (SELECT k, {_CORRS} AS strong FROM bars GROUP BY 1)
SELECT k, t, {rs('0.5 * least(1, greatest(0, (close - 15) / 30)) + 0.3 * (high - low) / 100 + 0.2 * abs(close - open) / 100')} AS stress, {_BIAS('(close - open) / 100', 0.2)} AS macro_trend, {_BIAS('((high + low) / 200 - 0.5)', 0.1)} AS leading_bias,
  CASE WHEN strong >= 3 THEN 'HIGH_CORRELATION' WHEN strong <= 1 THEN 'LOW_CORRELATION' ELSE 'NORMAL' END AS correlation_regime FROM bars JOIN s USING (k)""")
def macro_stress(spark: SparkSession, d: str) -> DataFrame:
    """The close as the volatility level, the bar's range and change as credit and currency stress."""
    df = tb.hourly(spark, d)
    strong = df.groupBy(F.col("k").alias("k2")).agg(sum((F.when(F.abs(F.corr("close", x)) > 0.5, 1).otherwise(0) for x in ("open", "high", "low", "volume")), F.lit(0)).alias("strong"))
    change, reach = (F.col("close") - F.col("open")) / 100, (F.col("high") - F.col("low")) / 100
    return rounded(df.join(strong, F.col("k") == F.col("k2")).select(
        "k", "t", feature_sets.stress(F.col("close"), reach, F.abs(change)).alias("stress"), feature_sets.bias(change, 0.2).alias("macro_trend"),
        feature_sets.bias((F.col("high") + F.col("low")) / 200 - 0.5, 0.1).alias("leading_bias"), feature_sets.correlation_regime(F.col("strong")).alias("correlation_regime"),
    ))


_FEATURES = ["open", "high", "low", "volume"]
_LONG = " UNION ALL ".join(f"SELECT k, t, '{x}' AS feature, {x}::DOUBLE AS x FROM bars" for x in _FEATURES)


@query("rolling_stability", B + f""", l AS ({_LONG}), n AS (SELECT *, row_number() OVER (PARTITION BY k, feature ORDER BY t) AS i, greatest(5, count(*) OVER (PARTITION BY k, feature) // 10)::INTEGER AS w FROM l),
  r AS (SELECT a.k, a.feature, a.i, a.w, avg(b.x) AS m, stddev_samp(b.x) AS s FROM n a JOIN n b ON a.k = b.k AND a.feature = b.feature AND b.i > a.i - a.w AND b.i <= a.i WHERE a.i >= a.w GROUP BY 1, 2, 3, 4),
  s AS (SELECT k, feature, w AS "window", CASE WHEN avg(s) > 0 AND avg(m) > 0 THEN 1 / (1 + avg(s) / avg(m)) ELSE 0 END AS score FROM r GROUP BY 1, 2, 3) SELECT k, feature, "window", {rs('score')} AS score, score > 0.3 AS stable FROM s""")
def rolling_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.rolling_stability(tb.hourly(spark, d), _FEATURES, "t"))


@query("most_informative", B + f""", g AS (SELECT k, t, least(coalesce(floor((close - min(close) OVER p) * 10 / nullif(max(close) OVER p - min(close) OVER p, 0)), 0), 9) AS y FROM bars WINDOW p AS (PARTITION BY k)), l AS ({_LONG}),
  b AS (SELECT l.k, feature, y, least(coalesce(floor((x - min(x) OVER p) * 10 / nullif(max(x) OVER p - min(x) OVER p, 0)), 0), 9) AS b FROM l JOIN g USING (k, t) WINDOW p AS (PARTITION BY l.k, feature)),
  c AS (SELECT k, feature, y, b, count(*)::DOUBLE AS n FROM b GROUP BY ALL), e AS (SELECT k, feature, n, sum(n) OVER (PARTITION BY k, feature) AS s, sum(n) OVER (PARTITION BY k, feature, y) AS sy, sum(n) OVER (PARTITION BY k, feature, b) AS sb FROM c),
  m AS (SELECT k, feature, sum(n / s * ln(n * s / (sy * sb))) AS mi FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mi DESC, feature)::INTEGER AS rank FROM m) SELECT k, feature, {rs('mi')} AS mi, rank FROM r WHERE rank <= 3""")
def most_informative(spark: SparkSession, d: str) -> DataFrame:
    """The three columns of a bar that tell most of its close."""
    return rounded(correlation.most_informative(tb.hourly(spark, d), _FEATURES, "close", 3))


@query("named_interactions", f"WITH a AS ({ORACLE_SQL['rsi_cutler']}), b AS ({ORACLE_SQL['sma_std_bb']}), {B.removeprefix('WITH ')}" + f""", x AS (SELECT k, t, close / 100 AS mood, volume, close - lag(close, 10) OVER ({W}) AS mom, high / 100 AS macro, high - low AS atr FROM bars)
SELECT k, t, {rs('rsi * bb_position')} AS rsi_bb_combo, CASE WHEN rsi < 30 AND bb_position < 0.2 THEN 1.0::DOUBLE ELSE 0.0 END AS oversold_squeeze, {rs('mood - rsi / 100')} AS sentiment_rsi_divergence,
  {rs('volume * sign(mom)')} AS whale_momentum_sync, {rs('macro * atr')} AS macro_volatility_interaction FROM a JOIN b USING (k, t) JOIN x USING (k, t)""")
def named_interactions(spark: SparkSession, d: str) -> DataFrame:
    bars = tb.hourly(spark, d).select("k", "t", (F.col("close") / 100).alias("sentiment"), F.col("volume").alias("whale"), (F.col("close") - F.lag("close", 10).over(by_time())).alias("momentum"), (F.col("high") / 100).alias("macro"), (F.col("high") - F.col("low")).alias("atr"))
    both = QUERIES["rsi_cutler"](spark, d).join(QUERIES["sma_std_bb"](spark, d), ["k", "t"]).join(bars, ["k", "t"])
    return rounded(both.select("k", "t", *[v.alias(n) for n, v in feature_sets.interactions().items()]))


_U = lambda i: f"(('0x' || substr(md5(concat_ws('|', '7', 'close', '{i}', k, epoch(t)::BIGINT)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query("noisy_series", B + f", s AS (SELECT k, stddev_samp(close) AS s FROM bars GROUP BY 1) SELECT k, t, {rs(f'close + coalesce(s, 0) * 0.01::DOUBLE * sqrt(-2 * ln({_U(0)})) * cos(2 * pi() * {_U(1)})')} AS close FROM bars JOIN s USING (k)")
def noisy_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(augment.noise(tb.hourly(spark, d).select("k", "t", "close"), ["close"], F.unix_timestamp("t"), 0.01, 7))


@query("stretched_values", B + f"SELECT k, t, {rs('(close - avg(close) OVER (PARTITION BY k)) * 1.05::DOUBLE + avg(close) OVER (PARTITION BY k)')} AS close FROM bars")
def stretched_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(augment.magnitude(tb.hourly(spark, d).select("k", "t", "close"), ["close"], by_time()))


@query("warped_time", B + f""", i AS (SELECT k, close, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM bars), m AS (SELECT DISTINCT k, n, CASE WHEN n < 10 THEN n ELSE greatest(10, floor(n / 1.1::DOUBLE))::BIGINT END AS m FROM i),
  j AS (SELECT k, n, m, unnest(range(m)) AS j FROM m), p AS (SELECT k, j, j * (n - 1) // greatest(m - 1, 1) AS a, (j * (n - 1) % greatest(m - 1, 1)) / greatest(m - 1, 1)::DOUBLE AS f FROM j)
SELECT p.k, j, {rs('CASE WHEN f = 0 THEN x.close ELSE x.close + f * (y.close - x.close) END')} AS close FROM p JOIN i x ON x.k = p.k AND x.i = a LEFT JOIN i y ON y.k = p.k AND y.i = a + 1""")
def warped_time(spark: SparkSession, d: str) -> DataFrame:
    return rounded(augment.time_warp(tb.hourly(spark, d), ["close"], "t"))
