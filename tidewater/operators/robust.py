"""Robust means, weighted medians and entropies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, clip
from ..functions.distributions import normal_cdf, normal_quantile


def weighted_mean(x: str, w: str) -> Column:
    return F.sum(c(x) * c(w)) / F.greatest(F.sum(w), F.lit(0.001))


def weighted_median(df: DataFrame, x: str, w: str, by: list[str]) -> DataFrame:
    """The first value whose cumulative weight reaches half; equal values are added up first."""
    each = df.groupBy(*by, x).agg(F.sum(w).alias("__w"))
    part = Window.partitionBy(*by)
    run = F.sum("__w").over(part.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("__c", run).withColumn("__t", F.sum("__w").over(part))
    return each.where(F.col("__c") >= F.col("__t") / 2).groupBy(*by).agg(F.min(x).alias("weighted_median"))


def trimmed_mean(df: DataFrame, x: str, by: list[str], share: float = 0.1) -> DataFrame:
    """Mean without the int(n * share) smallest and greatest values."""
    part = Window.partitionBy(*by)
    df = df.select(*by, x).withColumn("__i", F.row_number().over(part.orderBy(x))).withColumn("__n", F.count("*").over(part))
    cut = F.floor(F.col("__n") * share)
    return df.where((F.col("__i") > cut) & (F.col("__i") <= F.col("__n") - cut)).groupBy(*by).agg(F.avg(x).alias("trimmed_mean"))


def winsorised_mean(df: DataFrame, x: str, by: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    cuts = df.groupBy(*by).agg(F.percentile(x, F.lit(low)).alias("__a"), F.percentile(x, F.lit(high)).alias("__b"))
    return df.join(cuts, by).groupBy(*by).agg(F.avg(clip(x, F.col("__a"), F.col("__b"))).alias("winsorised_mean"))


def huber_mean(df: DataFrame, x: str, by: list[str], k: float = 1.345, rounds: int = 10) -> DataFrame:
    """Huber's estimator by reweighting: each round is one aggregate over the rows."""
    start = df.groupBy(*by).agg(F.median(x).alias("__m"))
    spread = df.join(start, by).groupBy(*by).agg(F.median(F.abs(c(x) - F.col("__m"))).alias("__s"), F.first("__m").alias("__m"))
    state = spread.withColumn("__s", F.greatest(F.col("__s") / 0.6745, F.lit(1e-9)))
    for _ in range(rounds):
        weight = F.least(F.lit(1.0), k / F.greatest(F.abs(c(x) - F.col("__m")) / F.col("__s"), F.lit(1e-12)))
        state = df.join(state, by).groupBy(*by).agg((F.sum(weight * c(x)) / F.sum(weight)).alias("__m"), F.first("__s").alias("__s"))
    return state.select(*by, F.col("__m").alias("huber_mean"))


def histogram_entropy(df: DataFrame, x: str, by: list[str], bins: int = 20) -> DataFrame:
    """Entropy in bits of an equal-width histogram between the group's extremes."""
    ends = df.groupBy(*by).agg(F.min(x).alias("__a"), F.max(x).alias("__b"))
    width = F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0))
    number = F.coalesce(F.least(F.floor((c(x) - F.col("__a")) / width * bins), F.lit(bins - 1)), F.lit(0))
    counts = df.join(ends, by).groupBy(*by, number.alias("__i")).agg(F.count("*").alias("__n"))
    p = F.col("__n") / F.sum("__n").over(Window.partitionBy(*by))
    return counts.withColumn("__p", p).groupBy(*by).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias("entropy"))


def permutation_entropy(df: DataFrame, x: str, o, by: str = "k") -> DataFrame:
    """Entropy in bits of the orderings of three neighbours, normalised by log2(6)."""
    a, b = F.lag(x, 2).over(o), F.lag(x, 1).over(o)
    code = F.concat((a <= b).cast("int"), (b <= c(x)).cast("int"), (a <= c(x)).cast("int"))
    counts = df.select(by, code.alias("code")).where("code IS NOT NULL").groupBy(by, "code").agg(F.count("*").alias("__n"))
    p = F.col("__n") / F.sum("__n").over(Window.partitionBy(by))
    return counts.withColumn("__p", p).groupBy(by).agg((-F.sum(F.col("__p") * F.log2("__p")) / float(np.log2(6))).alias("permutation_entropy"))


#: Poisson(1) distribution: a uniform number's place among these is its count.
_POISSON = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])


def poisson_weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(row, replicate) counts drawn from a hash of the row's id: the same wherever and however often a row is read."""
    h = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))[None, :]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)) / 2.0**53, "right").astype(float)


def bootstrap_replicates(df: DataFrame, x: str, by: str, row_id: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(k, b, m): the mean of each replicate of the Poisson bootstrap.

    Each row weighs a Poisson(1) count in each replicate, drawn from a hash of its ``row_id``, so the
    replicates do not depend on the partitioning, and tasks only add up ``replicates`` sums for each group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for key, rows in pdf.dropna(subset=["v"]).groupby("k"):
                for at in range(0, len(rows), 1024):
                    part = rows.iloc[at : at + 1024]
                    w = poisson_weights(part["i"].to_numpy(np.int64), replicates, seed)
                    sums[key] = sums.get(key, 0) + np.stack([part["v"].to_numpy(float) @ w, w.sum(0)])
        for key, (total, weight) in sums.items():
            yield pd.DataFrame({"k": key, "b": np.arange(replicates), "s": total, "w": weight})

    rows = df.select(F.col(by).cast("string").alias("k"), F.xxhash64(row_id).alias("i"), c(x).cast("double").alias("v"))
    parts = rows.mapInPandas(run, "k string, b int, s double, w double")
    return parts.groupBy("k", "b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))


def bootstrap_means(df: DataFrame, x: str, by: str, row_id: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(by, low, high): percentile interval of the mean by the Poisson bootstrap."""
    means = bootstrap_replicates(df, x, by, row_id, replicates, seed)
    return means.groupBy("k").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).withColumnRenamed("k", by)


def _quantile_of(held: Column, share: Column) -> Column:
    """The quantile of a sorted array, between its places in proportion."""
    at = share * (F.size(held) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(held, low), F.get(held, F.least(low + 1, F.size(held) - 1))
    return a + (b - a) * (at - low)


def bca_means(df: DataFrame, x: str, by: str, row_id: str, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, mean, bias, acceleration, low, high): bias-corrected, accelerated interval of the mean.

    The bias is the normal quantile of the share of replicates below the mean. The means without one row each differ
    from theirs by the row's deviation over n - 1, so the jackknife's acceleration is the sum of cubed deviations over six
    times the sum of squares to the power 1.5: two sums, no replicates. A key of constant x has its mean as both bounds.
    """
    means = bootstrap_replicates(df, x, by, row_id, replicates, seed).where("m IS NOT NULL")
    rows = df.select(F.col(by).cast("string").alias("k"), c(x).cast("double").alias("v")).where("v IS NOT NULL")
    one = rows.groupBy("k").agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.var_pop("v").alias("v2"), F.skewness("v").alias("g"))
    # sums of squares and cubes about the mean, from the aggregate's central moments
    acceleration = F.coalesce(F.col("g") / (6 * F.sqrt("n")), F.lit(0.0))
    found = means.join(one, "k").groupBy("k").agg(F.first("mean").alias("mean"), F.first(acceleration).alias("acceleration"), F.avg((F.col("m") < F.col("mean")).cast("double")).alias("below"), F.array_sort(F.collect_list("m")).alias("held"))
    edge = F.lit(0.5 / replicates)  # all or no replicates below: half a replicate's share
    found = found.withColumn("bias", normal_quantile(F.greatest(edge, F.least(1 - edge, F.col("below")))))

    def bound(share: float) -> Column:
        z = F.col("bias") + normal_quantile(F.lit(share))
        return _quantile_of(F.col("held"), normal_cdf(F.col("bias") + z / (1 - F.col("acceleration") * z)))

    tail = (1 - level) / 2
    return found.select(F.col("k").alias(by), "mean", "bias", "acceleration", bound(tail).alias("low"), bound(1 - tail).alias("high"))


def weighted_trimmed_mean(df: DataFrame, x: str, w: str, by: list[str], share: float = 0.1) -> DataFrame:
    """(by, trimmed_mean): the weighted mean without the int(n * share) rows of least and greatest x (ties by weight)."""
    part = Window.partitionBy(*by)
    rows = df.where(c(x).isNotNull() & c(w).isNotNull()).select(*by, c(x).alias("__x"), c(w).alias("__w"))
    rows = rows.withColumn("__i", F.row_number().over(part.orderBy("__x", "__w"))).withColumn("__n", F.count("*").over(part))
    cut = F.floor(F.col("__n") * share)
    kept = rows.where((F.col("__i") > cut) & (F.col("__i") <= F.col("__n") - cut))
    return kept.groupBy(*by).agg((F.sum(F.col("__x") * F.col("__w")) / F.nullif(F.sum("__w"), F.lit(0.0))).alias("trimmed_mean"))


def combined_estimate(df: DataFrame, x: str, w: str, by: list[str]) -> DataFrame:
    """(by, weighted_median, trimmed_mean, winsorised_mean, huber_mean, combined): four robust estimators and their mean."""
    found = weighted_median(df, x, w, by).join(weighted_trimmed_mean(df, x, w, by), by).join(winsorised_mean(df, x, by), by).join(huber_mean(df, x, by), by)
    names = ["weighted_median", "trimmed_mean", "winsorised_mean", "huber_mean"]
    return found.select(*by, *names, (sum(F.col(n) for n in names) / len(names)).alias("combined"))
