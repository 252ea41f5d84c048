"""Risk and performance of return series, by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, ratio, sample_kurtosis, sample_skewness, so_far

# Standard normal quantile and density at the confidence levels.
NORMAL = {90: (1.2815515655446004, 0.17549833193248685), 95: (1.6448536269514722, 0.10313564037537128), 99: (2.3263478740408408, 0.026652142203457633)}


def var_cvar(df: DataFrame, r: str, by: list[str], levels: tuple[int, ...] = (90, 95, 99)) -> DataFrame:
    """Historical and normal value at risk and expected shortfall."""
    cuts = df.groupBy(*by).agg(*[F.percentile(r, F.lit(1 - p / 100)).alias(f"var_{p}") for p in levels], F.avg(r).alias("__mu"), F.stddev_samp(r).alias("__sd"))
    rows = df.join(cuts, by)
    tails = rows.groupBy(*by).agg(*[F.avg(F.when(c(r) <= F.col(f"var_{p}"), c(r))).alias(f"cvar_{p}") for p in levels])
    normal = {}
    for p in levels:
        z, density = NORMAL[p]
        normal[f"normal_var_{p}"] = F.col("__mu") - z * F.col("__sd")
        normal[f"normal_cvar_{p}"] = F.col("__mu") - F.col("__sd") * (density / (1 - p / 100))
    return cuts.join(tails, by).withColumns(normal).drop("__mu", "__sd")


def ratios(df: DataFrame, r: str, by: list[str], periods: int = 252, drawdown: str | None = None) -> DataFrame:
    """Sharpe, Sortino, Omega, gain to pain, hit ratio, annualised figures and Jarque-Bera."""
    n, mean, sd = F.count(r), F.avg(r), F.stddev_samp(r)
    down = F.sqrt(F.sum(F.when(c(r) < 0, c(r) * c(r)).otherwise(0.0)) / n)
    gains, losses = F.sum(F.greatest(c(r), F.lit(0.0))), F.sum(F.greatest(-c(r), F.lit(0.0)))
    g1, g2 = F.skewness(r), F.kurtosis(r)
    return df.groupBy(*by).agg(
        (mean * periods).alias("annual_return"), (sd * math.sqrt(periods)).alias("annual_vol"), (ratio(mean, sd) * math.sqrt(periods)).alias("sharpe"), (ratio(mean, down) * math.sqrt(periods)).alias("sortino"),
        ratio(gains, losses).alias("omega"), ratio(F.sum(r), losses).alias("gain_to_pain"), F.avg((c(r) > 0).cast("double")).alias("hit_ratio"),
        (n / 6 * (g1 * g1 + g2 * g2 / 4)).alias("jarque_bera"), sample_skewness(g1, n).alias("skew"), sample_kurtosis(g2, n).alias("kurt"),
    )


def tail_stats(df: DataFrame, r: str, by: list[str]) -> DataFrame:
    """Tail ratio, expected shortfall and Hill index of the losses beyond the 90th percentile."""
    q = lambda p: F.percentile(r, F.lit(p))
    cuts = df.groupBy(*by).agg(q(0.05).alias("p05"), q(0.95).alias("p95"), F.percentile(-c(r), F.lit(0.9)).alias("__t"))
    rows = df.join(cuts, by)
    loss = -c(r)
    beyond = (loss > F.col("__t")) & (F.col("__t") > 0)
    found = rows.groupBy(*by, "p05", "p95").agg(
        F.avg(F.when(c(r) <= F.col("p05"), c(r))).alias("shortfall"), (1 / F.nullif(F.avg(F.when(beyond, F.ln(loss / F.nullif(F.col("__t"), F.lit(0.0))))), F.lit(0.0))).alias("hill")
    )
    return found.select(*by, ratio(F.abs("p95"), F.abs("p05")).alias("tail_ratio"), "shortfall", "hill")


def rolling_risk(r: str, o: WindowSpec, k: int) -> dict[str, Column]:
    """Over the k rows before the current one."""
    f = o.rowsBetween(-k, -1)
    whole = F.count(r).over(f) == k
    return {
        f"sharpe_{k}": F.when(whole, ratio(F.avg(r).over(f), F.stddev_samp(r).over(f))),
        f"vol_{k}": F.when(whole, F.stddev_samp(r).over(f)),
        f"var_{k}": F.when(whole, F.percentile(r, F.lit(0.05)).over(f)),
    }


def co_moments(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Co-skewness and co-kurtosis of two columns, from centred sums."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    m = both.groupBy(*by).agg(F.avg(a).alias("__ma"), F.avg(b).alias("__mb"), F.stddev_pop(a).alias("__sa"), F.stddev_pop(b).alias("__sb"))
    x, y = (c(a) - F.col("__ma")) / F.nullif(F.col("__sa"), F.lit(0.0)), (c(b) - F.col("__mb")) / F.nullif(F.col("__sb"), F.lit(0.0))
    return both.join(m, by).groupBy(*by).agg(F.avg(x * x * y).alias("coskew"), F.avg(x * x * x * y).alias("cokurt"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    e = c(actual) - c(predicted)
    return df.groupBy(*by).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(actual) * F.count(e), F.lit(0.0))).alias("r2"),
        (100 * F.avg(F.abs(e) / F.nullif(F.abs(c(actual)), F.lit(0.0)))).alias("mape"), F.max(F.abs(e)).alias("max_error"),
    )


def tail_value_at_risk(df: DataFrame, r: str, by: list[str], confidence: float = 0.99, share: float = 0.05) -> DataFrame:
    """(by, threshold, shape, scale, var, cvar): a generalised Pareto tail fitted to the losses beyond the ``share`` quantile.

    Shape and scale are the moment estimates (mean and variance of the excesses), so two aggregates do; keys with
    under 100 returns or 20 excesses have no row.
    """
    ends = df.groupBy(*by).agg(F.percentile(r, F.lit(share)).alias("threshold"), F.count(r).alias("__n")).where("__n >= 100")
    beyond = df.join(ends, by).where(F.col(r) <= F.col("threshold"))
    excess = F.col("threshold") - F.col(r)
    s = beyond.groupBy(*by, "threshold").agg(F.count("*").alias("__e"), F.avg(excess).alias("__m"), F.var_samp(excess).alias("__v")).where("__e >= 20")
    odds = F.col("__m") * F.col("__m") / F.nullif(F.col("__v"), F.lit(0.0))
    s = s.withColumns({"shape": (1 - odds) / 2, "scale": F.col("__m") * (1 + odds) / 2})
    grown = F.pow(F.lit((1 - confidence) / share), -F.col("shape"))
    s = s.withColumn("var", F.col("threshold") - F.col("scale") * (grown - 1) / F.nullif(F.col("shape"), F.lit(0.0)))
    return s.select(*by, "threshold", "shape", "scale", "var", (F.col("var") - F.col("scale") / F.nullif(1 - F.col("shape"), F.lit(0.0)) * grown).alias("cvar"))


def drawdown_report(df: DataFrame, r: str, o: WindowSpec, key: str = "k", t: str = "t") -> DataFrame:
    """(key, n, max_drawdown, start, trough, recovery, periods, frequency, underwater, mean_length) of the growth of returns.

    ``start`` is the peak before the deepest point, ``recovery`` the first row after it at that peak's height again (null
    if none is). A drawdown is a run of rows under the peak so far; ``frequency`` is their number over the rows,
    ``underwater`` the share of the rows in one. Null returns stand still.
    """
    wealth = F.exp(F.sum(F.log1p(F.coalesce(c(r), F.lit(0.0)))).over(so_far(o)))
    d = df.select(key, t, wealth.alias("__w"))
    d = d.withColumn("__p", F.greatest(F.max("__w").over(so_far(o)), F.lit(1.0)))
    d = d.withColumn("__d", F.when(F.col("__w") < F.col("__p") * (1 - 1e-12), F.col("__w") / F.col("__p") - 1).otherwise(0.0))
    under = F.col("__d") < 0
    begins = under & (F.coalesce(F.lag("__d").over(o), F.lit(0.0)) >= 0)
    d = d.withColumns({"__b": begins.cast("int"), "__top": F.when(~under, F.col(t))}).withColumn("__top", F.last("__top", ignorenulls=True).over(so_far(o)))
    # the deepest row, with its peak; the first of equal ones
    worst = d.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("__d", t, "__top", "__p")).alias("__x"), F.sum("__b").alias("periods"), F.avg(under.cast("double")).alias("underwater"), F.sum(under.cast("int")).alias("__u"))
    after = d.join(worst.select(F.col(key).alias("__k"), "__x"), F.col(key) == F.col("__k")).where((F.col(t) > F.col(f"__x.{t}")) & (F.col("__w") >= F.col("__x.__p") * (1 - 1e-12)))
    back = after.groupBy(key).agg(F.min(t).alias("recovery"))
    found = worst.join(back, key, "left")
    fell = F.col("__x.__d") < 0
    return found.select(key, "n", F.col("__x.__d").alias("max_drawdown"), F.when(fell, F.col("__x.__top")).alias("start"), F.when(fell, F.col(f"__x.{t}")).alias("trough"), F.when(fell, F.col("recovery")).alias("recovery"), "periods", (F.col("periods") / F.col("n")).alias("frequency"), "underwater", (F.col("__u") / F.nullif(F.col("periods"), F.lit(0))).alias("mean_length"))


def reward_ratios(df: DataFrame, r: str, by: list[str], periods: int = 252, free: float = 0.0, beta: float = 1.0, level: int = 95) -> DataFrame:
    """(by, treynor, return_to_var): the annual return's excess over beta, and the return over the annual value at risk."""
    cut = df.groupBy(*by).agg(F.percentile(r, F.lit(1 - level / 100)).alias("__v"), (F.avg(r) * periods).alias("__a"))
    return cut.select(*by, ((F.col("__a") - free) / beta).alias("treynor"), ratio(F.col("__a"), F.abs("__v") * math.sqrt(periods)).alias("return_to_var"))


def tail_dependence(df: DataFrame, r: str, o: WindowSpec, key: str = "k", share: float = 0.05) -> DataFrame:
    """(key, lower, upper): of the rows after one beyond the ``share`` quantile of their key, how many are beyond it, too."""
    cuts = df.groupBy(F.col(key).alias("__k")).agg(F.percentile(r, F.array(F.lit(share), F.lit(1 - share))).alias("__q"))
    d = df.select(key, c(r).alias("__r"), F.lag(r).over(o).alias("__l")).where("__r IS NOT NULL AND __l IS NOT NULL").join(cuts, F.col(key) == F.col("__k"))
    low, high = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    after = lambda before, now: ratio(F.count_if(before & now), F.count_if(before))
    return d.groupBy(key).agg(after(F.col("__l") < low, F.col("__r") < low).alias("lower"), after(F.col("__l") > high, F.col("__r") > high).alias("upper"))
