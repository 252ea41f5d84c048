"""Runs, regimes, peaks, breakouts and seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, islands, ratio, rolling


def classed(x: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """The name of the first step whose bound x is below."""
    out = F.when(x.isNull(), None)
    for bound, name in steps:
        out = out.when(x < bound, name)
    return out.otherwise(other)


def with_volatility(df: DataFrame, r: str, o: WindowSpec, k: int, out: str = "vol") -> DataFrame:
    return df.withColumn(out, rolling("std", r, o, k))


def with_islands(df: DataFrame, state: str, o: WindowSpec, out: str = "island") -> DataFrame:
    """Numbers the runs of equal ``state``."""
    df = df.withColumn("__p", F.lag(state).over(o))
    return df.withColumn(out, islands(~F.col(state).eqNullSafe(F.col("__p")), o)).drop("__p")


def runs(df: DataFrame, state: str, key: str = "k", t: str = "t") -> DataFrame:
    """One row for each island: its state, first and last time, and length."""
    return df.groupBy(key, "island").agg(F.first(state).alias(state), F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n"))


def transitions(runs_: DataFrame, state: str, key: str = "k") -> DataFrame:
    o = Window.partitionBy(key).orderBy("start")
    found = runs_.select(key, F.col("start").alias("t"), F.lag(state).over(o).alias("before"), F.col(state).alias("after"), F.lag("n").over(o).alias("previous_duration"))
    return found.where("before IS NOT NULL")


def transition_matrix(df: DataFrame, state: str, o: WindowSpec) -> DataFrame:
    """Counts of steps from one state to the next and their share by origin."""
    steps = df.select(F.lag(state).over(o).alias("before"), F.col(state).alias("after")).where("before IS NOT NULL")
    n = steps.groupBy("before", "after").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def regime_stats(df: DataFrame, state: str, r: str) -> DataFrame:
    found = df.groupBy(state).agg(
        F.count("*").alias("n"), F.avg("vol").alias("mean_vol"), F.max("vol").alias("max_vol"), F.min("vol").alias("min_vol"), F.avg(r).alias("mean_ret"),
        F.percentile(r, F.lit(0.05)).alias("var_5"), ratio(F.avg(r), F.stddev_samp(r)).alias("sharpe"), F.avg((c(r) > 0).cast("int")).alias("hit_ratio"),
    )
    return found.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def _last(df: DataFrame, n: int | None, key: str, t: str) -> DataFrame:
    if n is None:
        return df
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(t)))).where(F.col("__rn") <= n).drop("__rn")


def breakouts(df: DataFrame, o: WindowSpec, k: int, by: float, last: int | None = None, key: str = "k", t: str = "t") -> DataFrame:
    """Closes beyond the extreme of the k rows before by more than a share ``by``."""
    f = o.rowsBetween(-k, -1)
    df = df.withColumns({"__hi": F.max("close").over(f), "__lo": F.min("close").over(f), "__n": F.count("*").over(f)}).where(F.col("__n") == k)
    up, down = F.col("close") > F.col("__hi") * (1 + by), F.col("close") < F.col("__lo") * (1 - by)
    found = df.select(key, t, F.when(up, "up").when(down, "down").alias("kind"), F.when(up, ratio("close", "__hi") - 1).otherwise(ratio("close", "__lo") - 1).alias("strength"))
    return _last(found.where("kind IS NOT NULL"), last, key, t)


def reversals(df: DataFrame, o: WindowSpec, k: int, last: int | None = None, key: str = "k", t: str = "t") -> DataFrame:
    """Rows whose k-row trend has the other sign than k rows before."""
    df = df.select(key, t, F.signum(c("close") - F.lag("close", k).over(o)).alias("direction"))
    df = df.withColumn("__p", F.lag("direction", k).over(o))
    return _last(df.where(F.col("direction") * F.col("__p") < 0).drop("__p"), last, key, t)


def local_peaks(df: DataFrame, x: str, o: WindowSpec, key: str = "k", t: str = "t") -> DataFrame:
    """Rows strictly above or below both neighbours."""
    a, b = F.lag(x).over(o), F.lead(x).over(o)
    kind = F.when((c(x) > a) & (c(x) > b), "peak").when((c(x) < a) & (c(x) < b), "trough")
    return df.select(key, t, x, kind.alias("kind")).where("kind IS NOT NULL")


def seasonality(df: DataFrame, unit: Column, r: str, x: str, key: str = "k") -> DataFrame:
    return df.groupBy(key, unit.alias("unit")).agg(F.avg(r).alias("mean_ret"), F.stddev_samp(r).alias("std_ret"), F.avg(x).alias(f"mean_{x}"), F.count("*").alias("n"))


def best_worst(groups: DataFrame, x: str, tie: str, n: int) -> DataFrame:
    """The n groups of greatest and of least x; groups are few (hours, weekdays)."""
    best, worst = Window.orderBy(F.desc(x), tie), Window.orderBy(x, tie)
    df = groups.withColumns({"__b": F.row_number().over(best), "__w": F.row_number().over(worst)}).where((F.col("__b") <= n) | (F.col("__w") <= n))
    return df.withColumn("kind", F.when(F.col("__b") <= n, "best").otherwise("worst")).drop("__b", "__w")
