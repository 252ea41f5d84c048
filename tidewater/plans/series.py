"""Missing data, alignment, outliers, segments, seasonality and correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import c, clip, log_return, pct_change, ratio, sample_kurtosis, sample_skewness, so_far
from ..operators import asof, correlation, fill, outliers, segments
from ..sources import tables as tb
from ..sources.tables import by_time
from .indicators import B, D, full_sql, rs, windows
from .registry import HOURLY, W, query, r6, rounded, t_p_sql

SPINE = """spine AS (SELECT k, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM (SELECT k, min(t) AS a, max(t) AS b FROM bars GROUP BY k)),
  g AS (SELECT spine.k, spine.t, close AS x FROM spine LEFT JOIN bars USING (k, t))"""
G = f"WITH {HOURLY}, {SPINE} "


def gapped(spark: SparkSession, d: str) -> DataFrame:
    """(k, t, x): hourly closes on a spine without holes, null where no event fell."""
    bars = tb.hourly(spark, d)
    return tb.spine(bars).join(bars.select("k", "t", F.col("close").alias("x")), ["k", "t"], "left")


@query("spine_gaps", G + "SELECT k, t FROM g WHERE x IS NULL")
def spine_gaps(spark: SparkSession, d: str) -> DataFrame:
    return gapped(spark, d).where("x IS NULL").select("k", "t")


@query("ffill", G + f"""SELECT k, t, last_value(x IGNORE NULLS) OVER ({W}) AS filled, first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back_filled, coalesce(x, 0) AS zero_filled FROM g""")
def ffill(spark: SparkSession, d: str) -> DataFrame:
    return gapped(spark, d).select("k", "t", fill.forward("x", by_time()).alias("filled"), fill.backward("x", by_time()).alias("back_filled"), F.coalesce("x", F.lit(0.0)).alias("zero_filled"))


@query("median_fill", G + f"SELECT k, t, {rs('coalesce(x, (SELECT median(x) FROM g h WHERE h.k = g.k))')} AS filled FROM g")
def median_fill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gapped(spark, d).select("k", "t", F.coalesce("x", F.median("x").over(Window.partitionBy("k"))).alias("filled")))


_INTERP = f"""i AS (SELECT k, t, x, row_number() OVER ({W}) AS n FROM g), p AS (SELECT k, t, x, n, last_value(x IGNORE NULLS) OVER w AS px, last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER w AS pn,
  first_value(x IGNORE NULLS) OVER v AS nx, first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER v AS nn FROM i
  WINDOW w AS ({W}), v AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("interpolate", G + f", {_INTERP} SELECT k, t, {rs('CASE WHEN x IS NOT NULL THEN x WHEN px IS NULL THEN nx WHEN nx IS NULL THEN px ELSE px + (nx - px) * (n - pn) / (nn - pn) END')} AS x FROM p")
def interpolate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fill.interpolate(gapped(spark, d), "x", by_time()).select("k", "t", "x"))


@query("time_interpolate", B + f""", s AS (SELECT k, t, CASE WHEN hour(t) % 5 <> 0 THEN close END AS x FROM bars), p AS (SELECT k, t, x, last_value(x IGNORE NULLS) OVER w AS px, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER w AS pt,
  first_value(x IGNORE NULLS) OVER v AS nx, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER v AS nt FROM s WINDOW w AS ({W}), v AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT k, t, {rs('CASE WHEN x IS NOT NULL THEN x WHEN px IS NULL THEN nx WHEN nx IS NULL THEN px ELSE px + (nx - px) * (epoch(t) - epoch(pt)) / (epoch(nt) - epoch(pt)) END')} AS x FROM p""")
def time_interpolate(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", "t", F.when(F.hour("t") % 5 != 0, F.col("close")).alias("x"))
    return rounded(fill.interpolate(df, "x", by_time(), position=F.unix_timestamp("t")).select("k", "t", "x"))


@query("seasonal_fill", G + f""", i AS (SELECT k, t, x, row_number() OVER ({W}) % 24 AS ph FROM g) SELECT k, t, {rs('coalesce(x, avg(x) OVER (PARTITION BY k, ph))')} AS x FROM i""")
def seasonal_fill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fill.seasonal(gapped(spark, d), "x", by_time(), 24).select("k", "t", "x"))


@query("continuity", B + f""", s AS (SELECT k, epoch(t) - epoch(lag(t) OVER ({W})) AS s FROM bars) SELECT k, count(*) AS n, count(*) FILTER (s > 3600) AS breaks, max(s)::DOUBLE AS longest, mode(s)::DOUBLE AS usual,
  {rs('count(*) / (sum(coalesce(s, 3600)) / 3600)')} AS coverage FROM s GROUP BY k""")
def continuity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fill.continuity(tb.hourly(spark, d), 3600))


_DAYS = "SELECT date_trunc('day', ts)::TIMESTAMP AS t, event_type AS k, sum(value) AS v FROM events GROUP BY 1, 2"


@query("align_full_outer", f"WITH d AS ({_DAYS}), a AS (SELECT t, v AS a FROM d WHERE k = 'click' AND day(t) % 3 <> 0), b AS (SELECT t, v AS b FROM d WHERE k = 'view' AND day(t) % 4 <> 0) SELECT t, {rs('a')} AS a, {rs('b')} AS b FROM a FULL JOIN b USING (t)")
def align_full_outer(spark: SparkSession, d: str) -> DataFrame:
    days = tb.events(spark, d).groupBy(F.date_trunc("day", "ts").alias("t"), F.col("event_type").alias("k")).agg(F.sum("value").alias("v"))
    a = days.where("k = 'click' AND day(t) % 3 <> 0").select("t", F.col("v").alias("a"))
    b = days.where("k = 'view' AND day(t) % 4 <> 0").select("t", F.col("v").alias("b"))
    return rounded(asof.align([a, b], "t"))


_PIV = ", ".join(f"{rs(f'''max(v) FILTER (k = '{k}')''')} AS {k}" for k in ("click", "error", "purchase", "signup", "view"))


@query("align_pivot", f"WITH d AS ({_DAYS}) SELECT t, {_PIV} FROM d GROUP BY t")
def align_pivot(spark: SparkSession, d: str) -> DataFrame:
    days = tb.events(spark, d).groupBy(F.date_trunc("day", "ts").alias("t"), "event_type").agg(F.sum("value").alias("v"))
    return rounded(asof.align_long(days, "t", "event_type", "v", ["click", "error", "purchase", "signup", "view"]))


@query("inner_corr", f"WITH d AS ({_DAYS}), j AS (SELECT a.v AS x, b.v AS y FROM d a JOIN d b ON a.t = b.t WHERE a.k = 'click' AND b.k = 'view') SELECT {rs('corr(x, y)')} AS r, count(*) AS n FROM j")
def inner_corr(spark: SparkSession, d: str) -> DataFrame:
    days = tb.events(spark, d).groupBy(F.date_trunc("day", "ts").alias("t"), F.col("event_type").alias("k")).agg(F.sum("value").alias("v"))
    both = days.where("k = 'click'").select("t", F.col("v").alias("x")).join(days.where("k = 'view'").select("t", F.col("v").alias("y")), "t")
    return both.agg(r6(F.corr("x", "y")).alias("r"), F.count("*").alias("n"))


@query("asof_back", """WITH e AS (SELECT user_id AS k, ts AS t, event_id, value FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id AS k, ts AS vt, value AS vv FROM events WHERE event_type = 'view')
SELECT event_id, e.k, e.t, vt, vv FROM e ASOF LEFT JOIN v ON e.k = v.k AND e.t >= v.vt""")
def asof_back(spark: SparkSession, d: str) -> DataFrame:
    ev = tb.events(spark, d)
    left = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id")
    right = ev.where("event_type = 'view'").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.col("ts").alias("vt"), F.col("value").alias("vv"))
    return asof.asof_join(left, right, ["k"], "t").select("event_id", "k", "t", "vt", "vv")


@query("asof_forward_outcome", """WITH e AS (SELECT user_id AS k, ts AS t, ts + INTERVAL 30 MINUTE AS u, event_id, value FROM events WHERE event_type = 'click'), v AS (SELECT user_id AS k, ts AS vt, value AS vv FROM events WHERE event_type = 'view')
SELECT event_id, e.k, e.t, vt, vv, CASE WHEN vv IS NULL THEN NULL WHEN vv > value * 1.005 THEN 'up' WHEN vv < value * 0.995 THEN 'down' ELSE 'flat' END AS outcome FROM e ASOF LEFT JOIN v ON e.k = v.k AND e.u <= v.vt""")
def asof_forward_outcome(spark: SparkSession, d: str) -> DataFrame:
    ev = tb.events(spark, d)
    left = ev.where("event_type = 'click'").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("u"), "event_id", "value")
    right = ev.where("event_type = 'view'").select(F.col("user_id").alias("k"), F.col("ts").alias("u"), F.col("ts").alias("vt"), F.col("value").alias("vv"))
    outcome = F.when(F.col("vv").isNull(), None).when(F.col("vv") > F.col("value") * 1.005, "up").when(F.col("vv") < F.col("value") * 0.995, "down").otherwise("flat")
    return asof.asof_join(left, right, ["k"], "u", forward=True).select("event_id", "k", "t", "vt", "vv", outcome.alias("outcome"))


# -- outliers ---------------------------------------------------------------------------
@query("outliers_z", f"WITH s AS (SELECT event_id, event_type, value, (value - avg(value) OVER (PARTITION BY event_type)) / nullif(stddev_pop(value) OVER (PARTITION BY event_type), 0) AS z FROM events) SELECT event_id, {rs('z')} AS z FROM s WHERE abs(z) > 3")
def outliers_z(spark: SparkSession, d: str) -> DataFrame:
    df = outliers.with_z(tb.events(spark, d), "value", ["event_type"])
    return rounded(df.where("abs(z) > 3").select("event_id", "z"))


_IQR = "q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)"


@query("outliers_iqr", f"WITH {_IQR} SELECT event_id, value FROM events JOIN q USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    return outliers.with_iqr_flag(tb.events(spark, d), "value", ["event_type"], 1.5).where("iqr_flag").select("event_id", "value")


_MAD = "m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), a AS (SELECT event_type, median(abs(value - m)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)"


@query("outliers_mad", f"WITH {_MAD} SELECT event_id, {rs('0.6745 * (value - m) / nullif(mad, 0)')} AS modified_z FROM events JOIN m USING (event_type) JOIN a USING (event_type) WHERE abs(0.6745 * (value - m) / nullif(mad, 0)) > 3.5")
def outliers_mad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outliers.with_modified_z(tb.events(spark, d), "value", ["event_type"]).where("abs(modified_z) > 3.5").select("event_id", "modified_z"))


@query("outliers_rolling", B + f""", z AS (SELECT k, t, (close - CASE WHEN count(close) OVER c = 24 THEN avg(close) OVER c END) / nullif(stddev_samp(close) OVER c, 0) AS z FROM bars WINDOW c AS ({W} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)) SELECT k, t, {rs('z')} AS z FROM z WHERE abs(z) > 2.5""")
def outliers_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).withColumn("z", outliers.rolling_z("close", by_time(), 24)).where("abs(z) > 2.5").select("k", "t", "z"))


@query("outlier_vote", f"""WITH {_IQR}, {_MAD}, s AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1),
  v AS (SELECT event_id, value, m, (abs(value - mu) > 2 * sd)::INT + (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::INT + (abs(0.6745 * (value - m)) > 2.5 * mad)::INT AS votes FROM events JOIN q USING (event_type) JOIN m USING (event_type) JOIN a USING (event_type) JOIN s USING (event_type))
SELECT event_id, votes, {rs('CASE WHEN votes >= 2 THEN m ELSE value END')} AS cleaned FROM v""")
def outlier_vote(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outliers.vote(tb.events(spark, d), "value", ["event_type"], z=2.0, iqr=1.5, mad=2.5).select("event_id", "votes", "cleaned"))


@query("winsorize", f"WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) SELECT event_id, {rs('least(greatest(value, lo), hi)')} AS value FROM events JOIN q USING (event_type)")
def winsorize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outliers.winsorize(tb.events(spark, d), "value", ["event_type"], 0.01, 0.99).select("event_id", "value"))


@query("scale_robust", f"""WITH q AS (SELECT event_type, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_id, {rs('(value - m) / nullif(iqr, 0)')} AS robust, {rs('(value - mu) / nullif(sd, 0)')} AS standard, {rs('(value - lo) / nullif(hi - lo, 0)')} AS minmax FROM events JOIN q USING (event_type)""")
def scale_robust(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outliers.scaled(tb.events(spark, d), "value", ["event_type"]).select("event_id", "robust", "standard", "minmax"))


@query("quality_score", G + f""", s AS (SELECT k, x, t, lag(x) OVER ({W}) AS p FROM g), q AS (SELECT k, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM g GROUP BY 1),
  a AS (SELECT k, count(x) / count(*)::DOUBLE AS completeness, 1 - count(*) FILTER (x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1)) / nullif(count(x), 0)::DOUBLE AS validity, 1 - count(*) FILTER (x = p) / nullif(count(x), 0)::DOUBLE AS freshness,
    1 - least(stddev_pop(x) / nullif(abs(avg(x)), 0), 1) AS consistency, count(DISTINCT t) / count(*)::DOUBLE AS uniqueness, count(*) FILTER (x IS NOT NULL AND p IS NOT NULL) / (count(*) - 1)::DOUBLE AS continuity FROM s JOIN q USING (k) GROUP BY k)
SELECT k, {rs('completeness')} AS completeness, {rs('consistency')} AS consistency, {rs('validity')} AS validity, {rs('continuity')} AS continuity, {rs('uniqueness')} AS uniqueness, {rs('freshness')} AS freshness,
  {rs('0.25 * completeness + 0.20 * consistency + 0.25 * validity + 0.15 * continuity + 0.10 * uniqueness + 0.05 * freshness')} AS score FROM a""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outliers.quality_score(gapped(spark, d), "x", by_time()))


# -- segments ---------------------------------------------------------------------------
_VOL = f"""r AS (SELECT k, t, close, ln(close / nullif(lag(close) OVER ({W}), 0)) AS r FROM bars), v AS (SELECT k, t, close, r, {full_sql('stddev_samp(r)', 'r', 24)} AS vol FROM r {windows(24)}),
  c AS (SELECT k, t, close, r, vol, CASE WHEN vol < 1.2 THEN 'low' WHEN vol < 1.5 THEN 'medium' ELSE 'high' END AS regime FROM v WHERE vol IS NOT NULL),
  i AS (SELECT *, sum(CASE WHEN regime IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER ({W}) AS island FROM (SELECT *, lag(regime) OVER ({W}) AS p FROM c))"""


def vol_rows(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("r", log_return("close", by_time()))
    df = segments.with_volatility(df, "r", by_time(), 24).where("vol IS NOT NULL").withColumn("regime", segments.classed(c("vol"), [(1.2, "low"), (1.5, "medium")], "high"))
    return segments.with_islands(df, "regime", by_time())


_RUNS = "s AS (SELECT k, island, any_value(regime) AS regime, min(t) AS start, max(t) AS stop, count(*) AS n FROM i GROUP BY 1, 2)"


@query("vol_regimes", B + f", {_VOL}, {_RUNS} SELECT k, island::BIGINT AS island, regime, start, stop, n FROM s")
def vol_regimes(spark: SparkSession, d: str) -> DataFrame:
    return segments.runs(vol_rows(spark, d), "regime").select("k", "island", "regime", "start", "stop", "n")


@query("regime_transitions", B + f", {_VOL}, {_RUNS} SELECT k, start AS t, lag(regime) OVER (PARTITION BY k ORDER BY start) AS before, regime AS after, lag(n) OVER (PARTITION BY k ORDER BY start) AS previous_duration FROM s QUALIFY before IS NOT NULL")
def regime_transitions(spark: SparkSession, d: str) -> DataFrame:
    return segments.transitions(segments.runs(vol_rows(spark, d), "regime"), "regime")


@query("transition_matrix", B + f", {_VOL}, n AS (SELECT p, regime, count(*) AS n FROM i WHERE p IS NOT NULL GROUP BY 1, 2) SELECT p AS before, regime AS after, n, {rs('n / sum(n) OVER (PARTITION BY p)')} AS share FROM n")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.transition_matrix(vol_rows(spark, d), "regime", by_time()))


@query("regime_stats", B + f", {_VOL} SELECT regime, count(*) AS n, {rs('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct, {rs('avg(vol)')} AS mean_vol, {rs('max(vol)')} AS max_vol, {rs('min(vol)')} AS min_vol, {rs('avg(r)')} AS mean_ret, {rs('quantile_cont(r, 0.05)')} AS var_5, {rs('avg(r) / nullif(stddev_samp(r), 0)')} AS sharpe, {rs('avg((r > 0)::INT)')} AS hit_ratio FROM i GROUP BY 1")
def regime_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.regime_stats(vol_rows(spark, d), "regime", "r"))


@query("current_run", B + f", {_VOL}, {_RUNS} SELECT k, arg_max(regime, start) AS regime, arg_max(n, start) AS n FROM s GROUP BY k")
def current_run(spark: SparkSession, d: str) -> DataFrame:
    return segments.runs(vol_rows(spark, d), "regime").groupBy("k").agg(F.max_by("regime", "start").alias("regime"), F.max_by("n", "start").alias("n"))


@query("drawdown_periods", D + f""", r AS (SELECT k, t, (close / nullif(lag(close) OVER ({W}), 0) - 1) / 100 AS r FROM bars), e AS (SELECT k, t, exp(sum(ln(1 + coalesce(r, 0))) OVER ({W})) AS e FROM r), w AS (SELECT k, t, e / max(e) OVER ({W}) - 1 AS dd FROM e),
  f AS (SELECT *, dd <= -0.01 AS inside FROM w), g AS (SELECT *, sum(CASE WHEN inside IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER ({W}) AS island FROM (SELECT *, lag(inside) OVER ({W}) AS p FROM f))
SELECT k, min(t) AS start, max(t) AS stop, arg_min(t, dd) AS worst_at, {rs('min(dd)')} AS depth, count(*) AS n FROM g WHERE inside GROUP BY k, island""")
def drawdown_periods(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.columns import running, running_product

    df = tb.daily(spark, d).withColumn("r", pct_change("close", by_time()) / 100).withColumn("e", running_product("r", by_time()))
    df = df.withColumn("dd", F.col("e") / running("max", "e", by_time()) - 1).withColumn("inside", F.col("dd") <= -0.01)
    runs = segments.with_islands(df, "inside", by_time()).where("inside").groupBy("k", "island")
    return rounded(runs.agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.min_by("t", "dd").alias("worst_at"), F.min("dd").alias("depth"), F.count("*").alias("n")).drop("island"))


@query("breakouts", B + f""", p AS (SELECT k, t, close, max(close) OVER w AS hi, min(close) OVER w AS lo, count(*) OVER w AS n FROM bars WINDOW w AS ({W} ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)),
  b AS (SELECT k, t, CASE WHEN close > hi * 1.02 THEN 'up' WHEN close < lo * 0.98 THEN 'down' END AS kind, {rs('CASE WHEN close > hi * 1.02 THEN close / hi - 1 ELSE close / lo - 1 END')} AS strength FROM p WHERE n = 72)
SELECT k, t, kind, strength FROM b WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 10""")
def breakouts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.breakouts(tb.hourly(spark, d), by_time(), 72, 0.02, last=10))


@query("reversals", B + f""", p AS (SELECT k, t, sign(close - lag(close, 12) OVER ({W})) AS s FROM bars), q AS (SELECT k, t, s, lag(s, 12) OVER ({W}) AS p FROM p) SELECT k, t, s AS direction FROM q WHERE s * p < 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 5""")
def reversals(spark: SparkSession, d: str) -> DataFrame:
    return segments.reversals(tb.hourly(spark, d), by_time(), 12, last=5)


@query("local_peaks", B + f"SELECT k, t, close, CASE WHEN close > lag(close) OVER ({W}) AND close > lead(close) OVER ({W}) THEN 'peak' WHEN close < lag(close) OVER ({W}) AND close < lead(close) OVER ({W}) THEN 'trough' END AS kind FROM bars QUALIFY kind IS NOT NULL")
def local_peaks(spark: SparkSession, d: str) -> DataFrame:
    return segments.local_peaks(tb.hourly(spark, d), "close", by_time())


@query("consolidations", B + f""", m AS (SELECT k, t, close, avg(close) OVER ({W} ROWS 23 PRECEDING) AS a FROM bars), f AS (SELECT *, abs(close / a - 1) < 0.6 AS calm FROM m), g AS (SELECT *, sum(CASE WHEN calm IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER ({W}) AS island FROM (SELECT *, lag(calm) OVER ({W}) AS p FROM f))
SELECT k, min(t) AS start, max(t) AS stop, count(*) AS n, {rs('max(close) / min(close) - 1')} AS spread FROM g WHERE calm GROUP BY k, island HAVING count(*) >= 4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY min(t) DESC) <= 3""")
def consolidations(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("calm", F.abs(F.col("close") / F.avg("close").over(by_time().rowsBetween(-23, 0)) - 1) < 0.6)
    runs = segments.with_islands(df, "calm", by_time()).where("calm").groupBy("k", "island").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n"), (F.max("close") / F.min("close") - 1).alias("spread")).where("n >= 4")
    last = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("start")))
    return rounded(runs.withColumn("rn", last).where("rn <= 3").select("k", "start", "stop", "n", "spread"))


@query("trend_consistency", B + f""", n AS (SELECT k, row_number() OVER ({W}) - 1 AS i, sign(close - lag(close) OVER ({W})) AS s FROM bars) SELECT k, i // 12 AS segment, {rs('abs(sum(s)) / count(s)')} AS consistency FROM n GROUP BY 1, 2 HAVING count(s) >= 11""")
def trend_consistency(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", (F.row_number().over(by_time()) - 1).cast("long").alias("i"), F.signum(c("close") - F.lag("close").over(by_time())).alias("s"))
    return rounded(df.groupBy("k", F.floor(F.col("i") / 12).alias("segment")).agg((F.abs(F.sum("s")) / F.count("s")).alias("consistency"), F.count("s").alias("m")).where("m >= 11").drop("m"))


# -- seasonality and description ----------------------------------------------------------
def _season(name: str, unit_sql: str, unit) -> None:
    @query(name, B + f", r AS (SELECT k, t, close, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars) SELECT k, {unit_sql} AS unit, {rs('avg(r)')} AS mean_ret, {rs('stddev_samp(r)')} AS std_ret, {rs('avg(close)')} AS mean_close, count(*) AS n FROM r GROUP BY 1, 2")
    def seasonality(spark: SparkSession, d: str) -> DataFrame:
        df = tb.hourly(spark, d).withColumn("r", pct_change("close", by_time()))
        return rounded(segments.seasonality(df, unit(F.col("t")), "r", "close"))


_season("seasonality_hour", "hour(t)::INTEGER", F.hour)
_season("seasonality_dow", "(isodow(t) - 1)::INTEGER", F.weekday)
_season("seasonality_month", "month(t)::INTEGER", F.month)


@query("seasonality_strength", B + f", r AS (SELECT k, t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars), h AS (SELECT k, hour(t) AS h, avg(r) AS m FROM r GROUP BY 1, 2) SELECT k, {rs('stddev_pop(m)')} AS strength FROM h GROUP BY k")
def seasonality_strength(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("r", pct_change("close", by_time()))
    return rounded(df.groupBy("k", F.hour("t").alias("h")).agg(F.avg("r").alias("m")).groupBy("k").agg(F.stddev_pop("m").alias("strength")))


@query("best_worst_hours", B + f""", r AS (SELECT t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars), h AS (SELECT hour(t)::INTEGER AS hour, avg(r) AS m, count(r) AS n FROM r GROUP BY 1 HAVING count(r) >= 3),
  k AS (SELECT *, row_number() OVER (ORDER BY m DESC, hour) AS b, row_number() OVER (ORDER BY m, hour) AS w FROM h) SELECT hour, {rs('m')} AS mean_ret, n, CASE WHEN b <= 3 THEN 'best' ELSE 'worst' END AS kind FROM k WHERE b <= 3 OR w <= 3""")
def best_worst_hours(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("t", pct_change("close", by_time()).alias("r"))
    return rounded(segments.best_worst(df.groupBy(F.hour("t").alias("hour")).agg(F.avg("r").alias("mean_ret"), F.count("r").alias("n")).where("n >= 3"), "mean_ret", "hour", 3))


@query("describe_series", B + f""", r AS (SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars) SELECT k, count(*) AS n, {rs('avg(close)')} AS mean, {rs('stddev_samp(close)')} AS std, min(close) AS min, max(close) AS max, arg_max(close, t) AS last,
  {rs('100 * (max(close) - min(close)) / nullif(min(close), 0)')} AS range_pct, {rs('avg(r)')} AS mean_ret, {rs('stddev_samp(r)')} AS std_ret, {rs('skewness(close)')} AS skew, {rs('kurtosis(close)')} AS kurt, {rs('avg(r) / nullif(stddev_samp(r), 0)')} AS raw_sharpe FROM r GROUP BY k""")
def describe_series(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("r", pct_change("close", by_time()))
    n = F.count("close")
    return rounded(df.groupBy("k").agg(
        F.count("*").alias("n"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"), F.min("close").alias("min"), F.max("close").alias("max"), F.max_by("close", "t").alias("last"),
        (100 * ratio(F.max("close") - F.min("close"), F.min("close"))).alias("range_pct"), F.avg("r").alias("mean_ret"), F.stddev_samp("r").alias("std_ret"),
        sample_skewness(F.skewness("close"), n).alias("skew"), sample_kurtosis(F.kurtosis("close"), n).alias("kurt"), ratio(F.avg("r"), F.stddev_samp("r")).alias("raw_sharpe"),
    ))


# -- correlation --------------------------------------------------------------------------
_WIDE = "w AS (SELECT date_trunc('hour', ts) AS t, " + ", ".join(f"sum(value) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1)"
KINDS = ["click", "error", "purchase", "signup", "view"]


def wide(spark: SparkSession, d: str) -> DataFrame:
    return asof.align_long(tb.events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("t"), "event_type").agg(F.sum("value").alias("v")), "t", "event_type", "v", KINDS)


_PAIRS = [(a, b) for i, a in enumerate(KINDS) for b in KINDS[i + 1 :]]


@query("corr_matrix", f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rs(f'corr({a}, {b})')} AS r FROM w" for a, b in _PAIRS))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.matrix(wide(spark, d), KINDS))


@query("corr_pairs", f"WITH {_WIDE}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) + 0.0 AS r FROM w" for a, b in _PAIRS) + ") SELECT * FROM p WHERE abs(r) > 0.01 ORDER BY abs(r) DESC, a, b LIMIT 10")
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = correlation.matrix(wide(spark, d), KINDS).withColumn("r", F.round("r", 3) + F.lit(0.0))
    return m.where("abs(r) > 0.01").orderBy(F.desc(F.abs("r")), "a", "b").limit(10)


@query("spearman", f"""WITH {_WIDE}, x AS (SELECT click, view FROM w WHERE click IS NOT NULL AND view IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY click) + (count(*) OVER (PARTITION BY click) - 1) / 2.0 AS a, rank() OVER (ORDER BY view) + (count(*) OVER (PARTITION BY view) - 1) / 2.0 AS b, click, view FROM x),
  s AS (SELECT corr(click, view) AS p, corr(a, b) AS s, count(*) AS n FROM r), q AS (SELECT *, {t_p_sql('p * sqrt((n - 2) / (1 - p * p))', 'n - 2')} AS pp, {t_p_sql('s * sqrt((n - 2) / (1 - s * s))', 'n - 2')} AS sp FROM s), o AS (SELECT *, CASE WHEN pp < sp THEN p ELSE s END AS c FROM q)
SELECT {rs('p')} AS pearson, {rs('s')} AS spearman, n, {rs('pp')} AS pearson_p, {rs('sp')} AS spearman_p, {rs('c')} AS correlation, CASE WHEN abs(c) >= 0.7 THEN 'strong' WHEN abs(c) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM o""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.spearman(wide(spark, d), "click", "view"))


@query("autocorr", B + f""", r AS (SELECT k, t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars) """ + " UNION ALL ".join(f"SELECT k, {n}::INTEGER AS lag, {rs('corr(r, p)')} AS acf FROM (SELECT k, r, lag(r, {n}) OVER ({W}) AS p FROM r) GROUP BY k".replace("{n}", str(n)) for n in (1, 2, 5, 24)))
def autocorr(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("r", pct_change("close", by_time()))
    return rounded(correlation.autocorrelation(df, "r", by_time(), [1, 2, 5, 24]))


@query("corr_breakdown", f"WITH {_WIDE}, n AS (SELECT click, view, row_number() OVER (ORDER BY t DESC) AS rn FROM w) SELECT {rs('corr(click, view) FILTER (rn <= 48)')} AS recent, {rs('corr(click, view) FILTER (rn > 48)')} AS earlier, {rs('abs(corr(click, view) FILTER (rn <= 48) - corr(click, view) FILTER (rn > 48))')} AS shift FROM n")
def corr_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.breakdown(wide(spark, d), "click", "view", "t", 48))


@query("variance_topk", f"WITH {_WIDE}, u AS (UNPIVOT w ON click, error, purchase, signup, view INTO NAME name VALUE v) SELECT name, {rs('var_samp(v)')} AS variance FROM u GROUP BY 1 ORDER BY variance DESC, name LIMIT 3")
def variance_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(correlation.variance_topk(wide(spark, d), KINDS, 3))


@query("vol_persistence", B + f""", r AS (SELECT k, t, ln(close / nullif(lag(close) OVER ({W}), 0)) AS r FROM bars), v AS (SELECT k, t, {full_sql('stddev_samp(r)', 'r', 24)} AS v FROM r {windows(24)}), l AS (SELECT k, v, lag(v) OVER ({W}) AS p FROM v)
SELECT k, {rs('corr(v, p)')} AS acf_1, {rs('CASE WHEN corr(v, p) > 0 AND corr(v, p) < 1 THEN ln(0.5) / ln(corr(v, p)) END')} AS half_life, {rs('stddev_samp(v)')} AS vol_of_vol, {rs('1 - corr(v, p)')} AS reversion FROM l GROUP BY k""")
def vol_persistence(spark: SparkSession, d: str) -> DataFrame:
    df = segments.with_volatility(tb.hourly(spark, d).withColumn("r", log_return("close", by_time())), "r", by_time(), 24)
    rho = F.corr("vol", "p")
    return rounded(df.withColumn("p", F.lag("vol").over(by_time())).groupBy("k").agg(rho.alias("acf_1"), F.when((rho > 0) & (rho < 1), F.ln(F.lit(0.5)) / F.ln(rho)).alias("half_life"), F.stddev_samp("vol").alias("vol_of_vol"), (1 - rho).alias("reversion")))


@query("decompose", G + f""", f AS (SELECT k, t, coalesce(last_value(x IGNORE NULLS) OVER ({W}), 0) AS x, (row_number() OVER ({W}) - 1) % 24 AS ph FROM g), tr AS (SELECT *, avg(x) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend FROM f), s AS (SELECT *, avg(x - trend) OVER (PARTITION BY k, ph) AS seasonal FROM tr)
SELECT k, t, {rs('trend')} AS trend, {rs('seasonal')} AS seasonal, {rs('x - trend - seasonal')} AS residual FROM s""")
def decompose(spark: SparkSession, d: str) -> DataFrame:
    df = gapped(spark, d).withColumn("x", F.coalesce(fill.forward("x", by_time()), F.lit(0.0)))
    return rounded(fill.decompose(df, "x", by_time(), 24).select("k", "t", "trend", "seasonal", "residual"))


@query("range_clip", B + f"SELECT k, t, least(greatest(close, 10), 90) AS clipped, close BETWEEN 10 AND 90 AS valid, CASE WHEN close > 60 THEN 1 WHEN close < 30 THEN -1 ELSE 0 END::INTEGER AS signal FROM bars")
def range_clip(spark: SparkSession, d: str) -> DataFrame:
    return tb.hourly(spark, d).select("k", "t", clip("close", 10.0, 90.0).alias("clipped"), F.col("close").between(10, 90).alias("valid"), F.when(F.col("close") > 60, 1).when(F.col("close") < 30, -1).otherwise(0).alias("signal"))


@query("trend_fit", B + f", n AS (SELECT k, close, row_number() OVER ({W})::DOUBLE AS i FROM bars) SELECT k, {rs('regr_slope(close, i)')} AS slope, {rs('regr_intercept(close, i)')} AS intercept, {rs('regr_r2(close, i)')} AS r2, {rs('sqrt(regr_syy(close, i) * (1 - regr_r2(close, i)) / count(*))')} AS detrended FROM n GROUP BY k")
def trend_fit(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).select("k", "close", F.row_number().over(by_time()).cast("double").alias("i"))
    r2 = F.regr_r2("close", "i")
    return rounded(df.groupBy("k").agg(F.regr_slope("close", "i").alias("slope"), F.regr_intercept("close", "i").alias("intercept"), r2.alias("r2"), F.sqrt(F.regr_syy("close", "i") * (1 - r2) / F.count("*")).alias("detrended")))


@query("running_state", B + f"SELECT k, t, count(*) OVER ({W}) AS n, {rs(f'sum(close) OVER ({W})')} AS total FROM bars")
def running_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tb.hourly(spark, d).select("k", "t", F.count("*").over(so_far(by_time())).alias("n"), F.sum("close").over(so_far(by_time())).alias("total")))
