"""Correlation, rank correlation, autocorrelation and pruning of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.distributions import t_p
from .significance import equal_bins, mutual_information


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair a before b: all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("p"))
    return long.select("p.*")


def drop_correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """The columns left after dropping each that correlates above ``limit`` with an earlier one."""
    over = {r["b"] for r in matrix(df, columns).where(F.abs("r") > limit).collect()}  # pairs of columns, not rows
    return [x for x in columns if x not in over]


def useful_columns(df: DataFrame, columns: list[str], most_null: float = 0.5, least_variance: float = 1e-8) -> list[str]:
    """Columns with enough values and variance, without equal copies: one wide aggregate."""
    aggs = [f(x).alias(f"{x}|{n}") for x in columns for n, f in (("n", F.count), ("v", F.var_samp))]
    hashes = [F.sum(F.xxhash64(x).cast("decimal(38,0)")).alias(f"{x}|h") for x in columns]
    row = df.agg(F.count("*").alias("|n"), *aggs, *hashes).collect()[0]
    kept, seen = [], set()
    for x in columns:
        if row["|n"] and row[f"{x}|n"] / row["|n"] >= 1 - most_null and (row[f"{x}|v"] or 0) > least_variance and row[f"{x}|h"] not in seen:
            seen.add(row[f"{x}|h"])
            kept.append(x)
    return kept


#: Ranges that ranks are worked out in; so many rows at most are broadcast.
RANGES = 256


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman (average ranks) of two columns over the rows that have both, with two-sided p-values.

    ``correlation`` is the one of the smaller p-value (Spearman's if equal), ``strength`` its size in words.
    Ranks come from counts by value, in ranges of about equal numbers of values: a running sum
    within each range, and before it the sum of the ranges below (one row a range).
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)

    def ranks(x: str, out: str) -> DataFrame:
        counts = both.groupBy(x).agg(F.count("*").alias("__n"))
        bounds = sorted(set(both.approxQuantile(x, [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)))
        counts = counts.withColumn("__p", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda v: v <= F.col(x))) if bounds else F.lit(0))
        below = counts.groupBy("__p").agg(F.sum("__n").alias("__b")).withColumn("__b", F.sum("__b").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__b"))
        within = F.sum("__n").over(Window.partitionBy("__p").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
        return counts.withColumn("__w", within).join(F.broadcast(below), "__p").select(x, (F.col("__b") + F.col("__w") + (F.col("__n") + 1) / 2).alias(out))

    ranked = both.join(ranks(a, "__ra"), a).join(ranks(b, "__rb"), b)
    found = ranked.agg(F.corr(a, b).alias("pearson"), F.corr("__ra", "__rb").alias("spearman"), F.count("*").alias("n"))
    free = F.col("n") - 2
    found = found.withColumns({f"{r}_p": t_p(F.col(r) * F.sqrt(ratio(free, 1 - F.col(r) * F.col(r))), free) for r in ("pearson", "spearman")})
    found = found.withColumn("correlation", F.when(F.col("pearson_p") < F.col("spearman_p"), F.col("pearson")).otherwise(F.col("spearman")))
    size = F.abs("correlation")  # fixed values: the bounds of the strengths
    return found.withColumn("strength", F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size.isNotNull(), "weak"))


def autocorrelation(df: DataFrame, x: str, o: WindowSpec, lags: list[int], key: str = "k") -> DataFrame:
    """Pearson correlation of x with its lags, by key."""
    wide = df.select(key, F.col(x).alias("__x"), *[F.lag(x, n).over(o).alias(f"__{n}") for n in lags])
    one = wide.groupBy(key).agg(*[F.corr("__x", f"__{n}").alias(str(n)) for n in lags])
    return one.unpivot([key], [str(n) for n in lags], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def breakdown(df: DataFrame, a: str, b: str, t: str, recent: int) -> DataFrame:
    """Correlation over the last ``recent`` rows against the rows before."""
    last = df.select(t).orderBy(F.desc(t)).limit(recent).agg(F.min(t).alias("__from"))
    rows = df.join(F.broadcast(last), how="inner", on=F.lit(True))  # one row
    x, y = F.col(a), F.col(b)
    new, old = F.col(t) >= F.col("__from"), F.col(t) < F.col("__from")
    found = rows.agg(F.corr(F.when(new, x), F.when(new, y)).alias("recent"), F.corr(F.when(old, x), F.when(old, y)).alias("earlier"))
    return found.withColumn("shift", F.abs(F.col("recent") - F.col("earlier")))


def variance_topk(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    one = df.agg(*[F.var_samp(x).alias(x) for x in columns])
    return one.unpivot([], columns, "name", "variance").orderBy(F.desc("variance"), "name").limit(k)


def long_form(df: DataFrame, columns: list[str], keep: list[str], name: str = "feature", value: str = "x") -> DataFrame:
    """(keep, name, value): one row for each of ``columns``, as doubles."""
    each = F.array(*[F.struct(F.lit(n).alias(name), F.col(n).cast("double").alias(value)) for n in columns])
    return df.select(*keep, F.explode(each).alias("__e")).select(*keep, f"__e.{name}", f"__e.{value}")


def rolling_stability(df: DataFrame, columns: list[str], t: str, key: str = "k", least: float = 0.3) -> DataFrame:
    """(key, feature, window, score, stable): 1 / (1 + mean rolling deviation over the mean rolling mean), windows of a tenth of the rows, 5 at least.

    Missing values become the median; a mean that is not positive scores 0; keys of fewer than 20 rows have no score and
    stay stable. Windows come from running sums, each row's given to the window it ends and to the one it leaves: one
    aggregate by position, whatever the window's length. The median holds a key's distinct values in one task: give it bars.
    """
    rows = long_form(df, columns, [key, t])
    size = rows.groupBy(key, "feature").agg(F.count("*").alias("n"), F.median("x").alias("__md"), F.avg("x").alias("__m"))
    size = size.withColumn("window", F.greatest(F.lit(5), F.floor(F.col("n") / 10)).cast("int")).withColumnsRenamed({key: "__k", "feature": "__f"})
    o = Window.partitionBy(key, "feature").orderBy(t)
    x = F.coalesce("x", "__md") - F.col("__m")
    rows = rows.join(size, F.col(key).eqNullSafe(F.col("__k")) & (F.col("feature") == F.col("__f"))).withColumn("__x", x)
    rows = rows.withColumns({"__i": F.row_number().over(o), "__s": F.sum("__x").over(o.rowsBetween(Window.unboundedPreceding, 0)), "__q": F.sum(F.col("__x") * F.col("__x")).over(o.rowsBetween(Window.unboundedPreceding, 0))})
    w = F.col("window")
    ends = F.array(F.struct(F.col("__i").alias("p"), F.lit(1).alias("d")), F.struct((F.col("__i") + w).alias("p"), F.lit(-1).alias("d")))
    at = rows.withColumn("__e", F.explode(ends)).where((F.col("__e.p") >= w) & (F.col("__e.p") <= F.col("n")))
    sums = at.groupBy(key, "feature", "n", "window", "__m", "__e.p").agg(F.sum(F.col("__e.d") * F.col("__s")).alias("__s"), F.sum(F.col("__e.d") * F.col("__q")).alias("__q"))
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("__q") - F.col("__s") * F.col("__s") / w) / (w - 1)))
    means = sums.groupBy(key, "feature", "n", "window").agg(F.avg(F.col("__s") / w + F.col("__m")).alias("__mean"), F.avg(spread).alias("__std"))
    score = F.when((F.col("__std") > 0) & (F.col("__mean") > 0), 1 / (1 + F.col("__std") / F.col("__mean"))).otherwise(0.0)
    known = means.withColumn("score", F.when(F.col("n") >= 20, score))
    found = size.select(F.col("__k").alias(key), F.col("__f").alias("feature"), "window").join(known.select(F.col(key).alias("__k"), F.col("feature").alias("__f"), "score"), F.col(key).eqNullSafe(F.col("__k")) & (F.col("feature") == F.col("__f")), "left")
    return found.select(key, "feature", "window", "score", (F.col("score").isNull() | (F.col("score") > least)).alias("stable"))


def most_informative(df: DataFrame, features: list[str], target: str, keep: int, bins: int = 10, key: str = "k") -> DataFrame:
    """(key, feature, mi, rank): the ``keep`` features whose ``bins`` equal parts tell most (nats) of the target's; equal ones by name."""
    rows = long_form(equal_bins(df, target, bins, [key], "__y"), features, [key, "__y"])
    mi = mutual_information(equal_bins(rows, "x", bins, [key, "feature"], "__b"), "__b", "__y", [key, "feature"])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("mi"), "feature"))
    return mi.withColumn("rank", rank).where(F.col("rank") <= keep)
