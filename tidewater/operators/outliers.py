"""Outliers, clipping, scaling and data quality, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, clip, full, ratio


def _stats(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    """``df`` with group statistics joined back: small, since one row a group; adaptive execution picks the join."""
    return df.join(df.groupBy(*by).agg(*aggs), by)


def with_z(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """z from the mean and the population deviation."""
    df = _stats(df, by, F.avg(x).alias("__mu"), F.stddev_pop(x).alias("__sd"))
    return df.withColumn("z", ratio(c(x) - F.col("__mu"), "__sd")).drop("__mu", "__sd")


def with_iqr_flag(df: DataFrame, x: str, by: list[str], k: float = 3.0) -> DataFrame:
    df = _stats(df, by, F.percentile(x, F.lit(0.25)).alias("__a"), F.percentile(x, F.lit(0.75)).alias("__b"))
    reach = k * (F.col("__b") - F.col("__a"))
    return df.withColumn("iqr_flag", (c(x) < F.col("__a") - reach) | (c(x) > F.col("__b") + reach)).drop("__a", "__b")


def with_modified_z(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """0.6745 times the distance from the median over the median distance."""
    df = _stats(df, by, F.median(x).alias("__m"))
    df = _stats(df, by, F.median(F.abs(c(x) - F.col("__m"))).alias("__mad"))
    return df.withColumn("modified_z", ratio(0.6745 * (c(x) - F.col("__m")), "__mad")).drop("__m", "__mad")


def rolling_z(x: str, o: WindowSpec, k: int) -> Column:
    """z against a centred window of k rows (even k: k/2 before, k/2 - 1 after)."""
    f = o.rowsBetween(-(k // 2), k - 1 - k // 2)
    return ratio(c(x) - full(F.avg(x).over(f), x, f, k), F.stddev_samp(x).over(f))


def vote(df: DataFrame, x: str, by: list[str], z: float, iqr: float, mad: float, majority: int = 2) -> DataFrame:
    """Votes of three detectors; where they reach ``majority`` the value is replaced by the group's median."""
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    df = _stats(df, by, F.avg(x).alias("__mu"), F.stddev_pop(x).alias("__sd"), quartiles.alias("__q")).withColumns({"__m": F.get("__q", F.lit(1)), "__lo": F.get("__q", F.lit(0)), "__hi": F.get("__q", F.lit(2))})
    df = _stats(df, by, F.median(F.abs(c(x) - F.col("__m"))).alias("__mad"))
    reach = iqr * (F.col("__hi") - F.col("__lo"))
    df = df.withColumns({"z": ratio(c(x) - F.col("__mu"), "__sd"), "iqr_flag": (c(x) < F.col("__lo") - reach) | (c(x) > F.col("__hi") + reach), "modified_z": ratio(0.6745 * (c(x) - F.col("__m")), "__mad")})
    on = lambda b: F.coalesce(b, F.lit(False)).cast("int")
    df = df.withColumn("votes", on(F.abs("z") > z) + on(F.col("iqr_flag")) + on(F.abs("modified_z") > mad))
    df = df.withColumn("cleaned", F.when(F.col("votes") >= majority, F.col("__m")).otherwise(c(x)))
    return df.drop("__mu", "__sd", "__q", "__m", "__lo", "__hi", "__mad")


def winsorize(df: DataFrame, x: str, by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    df = _stats(df, by, F.percentile(x, F.lit(low)).alias("__a"), F.percentile(x, F.lit(high)).alias("__b"))
    return df.withColumn(x, clip(x, F.col("__a"), F.col("__b"))).drop("__a", "__b")


def scaled(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    q = lambda p: F.percentile(x, F.lit(p))
    df = _stats(df, by, F.median(x).alias("__m"), (q(0.75) - q(0.25)).alias("__i"), F.avg(x).alias("__mu"), F.stddev_pop(x).alias("__sd"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    df = df.withColumns({"robust": ratio(c(x) - F.col("__m"), "__i"), "standard": ratio(c(x) - F.col("__mu"), "__sd"), "minmax": ratio(c(x) - F.col("__lo"), F.col("__hi") - F.col("__lo"))})
    return df.drop("__m", "__i", "__mu", "__sd", "__lo", "__hi")


# Weights of the parts of the quality score.
QUALITY_WEIGHTS = {"completeness": 0.25, "consistency": 0.20, "validity": 0.25, "continuity": 0.15, "uniqueness": 0.10, "freshness": 0.05}


def quality_score(df: DataFrame, x: str, o: WindowSpec, key: str = "k", t: str = "t") -> DataFrame:
    """Six parts of data quality per key and their weighted sum."""
    df = df.withColumn("__p", F.lag(x).over(o))
    df = _stats(df, [key], F.percentile(x, F.lit(0.25)).alias("__a"), F.percentile(x, F.lit(0.75)).alias("__b"))
    reach = 3 * (F.col("__b") - F.col("__a"))
    n, known = F.count("*"), F.nullif(F.count(x), F.lit(0))
    parts = df.groupBy(key).agg(
        (F.count(x) / n).alias("completeness"),
        (1 - F.least(F.stddev_pop(x) / F.nullif(F.abs(F.avg(x)), F.lit(0.0)), F.lit(1.0))).alias("consistency"),
        (1 - F.count_if((c(x) < F.col("__a") - reach) | (c(x) > F.col("__b") + reach)) / known).alias("validity"),
        (F.count_if(c(x).isNotNull() & F.col("__p").isNotNull()) / (n - 1)).alias("continuity"),
        (F.countDistinct(t) / n).alias("uniqueness"),
        (1 - F.count_if(c(x) == F.col("__p")) / known).alias("freshness"),
    )
    total = sum((w * F.col(p) for p, w in QUALITY_WEIGHTS.items()), F.lit(0.0))
    return parts.withColumn("score", total)


def drop_iqr_rows(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Rows in which no column lies beyond k interquartile ranges; one aggregate gives all bounds."""
    bounds = df.agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias(x) for x in columns]).collect()[0]
    for x in columns:
        a, b = bounds[x]
        df = df.where(F.col(x).isNull() | F.col(x).between(a - k * (b - a), b + k * (b - a)))
    return df


def clip_beyond_tails(df: DataFrame, x: str, by: list[str], low: float = 0.01, high: float = 0.99, k: float = 1.5) -> DataFrame:
    """x held within ``k`` times the gap of two far quantiles beyond them."""
    df = _stats(df, by, F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("__q"))
    a, b = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    return df.withColumn(x, clip(x, a - k * (b - a), b + k * (b - a))).drop("__q")
