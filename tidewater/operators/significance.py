"""Two-sample tests, effect sizes, change points and feature scores, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, ratio, running
from ..functions.distributions import chi2_p, f_p, f_p_two_sided, normal_p, t_p
from ..functions.linear import dot, moments, solve

#: Terms of the Kolmogorov distribution's series.
TERMS = 20


def effect_sizes(df: DataFrame, x: str, group: str, by: list[str]) -> DataFrame:
    """Cohen's d (pooled), Hedges' g and Glass's delta of group 1 against group 0, with a label; t with its two-sided p-value."""
    one, two = F.when(F.col(group) == 1, c(x)), F.when(F.col(group) == 0, c(x))
    found = df.groupBy(*by).agg(F.count(one).alias("n1"), F.count(two).alias("n0"), F.avg(one).alias("m1"), F.avg(two).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v0"))
    free = F.col("n1") + F.col("n0") - 2
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / free)
    gap = F.col("m1") - F.col("m0")
    found = found.withColumn("cohen_d", ratio(gap, pooled)).withColumn("hedges_g", F.col("cohen_d") * (1 - 3 / (4 * free - 1)))
    found = found.withColumn("glass_delta", ratio(gap, F.sqrt("v0"))).withColumn("t_stat", ratio(gap, pooled * F.sqrt(1 / F.col("n1") + 1 / F.col("n0"))))
    size = F.abs("cohen_d")
    label = F.when(size.isNull(), None).when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return found.select(*by, "n1", "n0", "cohen_d", "hedges_g", "glass_delta", "t_stat", t_p("t_stat", free).alias("t_p"), label.alias("label"))


def rank_sum(df: DataFrame, x: str, group: str, by: list[str]) -> DataFrame:
    """z of the rank-sum test and its two-sided p-value by key: average ranks, the variance corrected for ties.

    Values are counted first, so ranks come from a running count over a key's distinct values.
    """
    values = df.where(c(x).isNotNull()).groupBy(*by, x).agg(F.count_if(F.col(group) == 1).alias("__1"), F.count_if(F.col(group) == 0).alias("__0"))
    tied = F.col("__1") + F.col("__0")
    values = values.withColumn("__t", tied).withColumn("__r", running("sum", "__t", Window.partitionBy(*by).orderBy(x)) - (F.col("__t") - 1) / 2)
    t = F.col("__t").cast("double")
    found = values.groupBy(*by).agg(F.sum(F.col("__1") * F.col("__r")).alias("__w"), F.sum("__1").alias("__a"), F.sum("__0").alias("__b"), F.sum(t * t * t - t).alias("__ties"))
    a, b = F.col("__a"), F.col("__b")
    n = a + b
    spread = a * b / 12 * (n + 1 - ratio("__ties", n * (n - 1)))
    z = ratio(F.col("__w") - a * (n + 1) / 2, F.sqrt(spread))
    return found.select(*by, z.alias("rank_sum_z")).withColumn("rank_sum_p", normal_p("rank_sum_z"))


def kolmogorov_smirnov(df: DataFrame, x: str, group: str, by: list[str]) -> DataFrame:
    """The greatest distance of the two groups' distributions and its asymptotic p-value, by key."""
    values = df.where(c(x).isNotNull()).groupBy(*by, x).agg(F.count_if(F.col(group) == 1).alias("__a"), F.count_if(F.col(group) == 0).alias("__b"))
    so_far = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    each = values.select(*by, F.sum("__a").over(so_far).alias("__ca"), F.sum("__b").over(so_far).alias("__cb"), "__a", "__b")
    totals = values.groupBy(*by).agg(F.sum("__a").alias("__na"), F.sum("__b").alias("__nb"))
    gap = F.abs(ratio("__ca", "__na") - ratio("__cb", "__nb"))
    found = each.join(totals, by).groupBy(*by).agg(F.max(gap).alias("ks"), F.first(F.sqrt(F.col("__na") * F.col("__nb") / (F.col("__na") + F.col("__nb")))).alias("__e"))
    s = F.col("__e") * F.col("ks")
    series = sum(((-1) ** (k - 1)) * F.exp(-2.0 * k * k * s * s) for k in range(1, TERMS + 1))
    return found.select(*by, "ks", F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)).alias("p"))


def adjusted(df: DataFrame, p: str, by: str) -> DataFrame:
    """Adds bonferroni and holm to one p-value a row; the rows are tests (a key's number of tests), not data."""
    o = Window.orderBy(p, by)
    step = (F.col("__m") - F.row_number().over(o) + 1) * F.col(p)
    found = df.withColumn("__m", F.count("*").over(Window.partitionBy())).withColumn("__s", step)
    holm = F.least(F.max("__s").over(o.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return found.withColumn("bonferroni", F.least(F.col(p) * F.col("__m"), F.lit(1.0))).withColumn("holm", holm).drop("__m", "__s")


def variance_change(df: DataFrame, x: str, o: WindowSpec, least: int, key: str = "k") -> DataFrame:
    """Adds f_stat, the variance (ddof 0) from a row on over that before it, where both parts have ``least`` rows, and its
    two-sided p-value; a change point is where that is under 0.01.

    Running sums of the values' deviations from the key's mean and of their squares give both variances in one pass.
    """
    total = df.groupBy(F.col(key).alias("__k")).agg(F.avg(x).alias("__m"), F.count(x).alias("__n"), F.var_pop(x).alias("__v"))
    df = df.where(c(x).isNotNull()).join(total, F.col(key) == F.col("__k")).withColumn("__d", c(x) - F.col("__m"))
    i = F.row_number().over(o) - 1
    df = df.withColumns({"__i": i, "__s": running("sum", "__d", o) - F.col("__d"), "__q": running("sum", F.col("__d") * F.col("__d"), o) - F.col("__d") * F.col("__d")})
    n, m = F.col("__i"), F.col("__n") - F.col("__i")
    before = F.col("__q") / n - (F.col("__s") / n) * (F.col("__s") / n)
    after = (F.col("__v") * F.col("__n") - F.col("__q")) / m - (F.col("__s") / m) * (F.col("__s") / m)
    f = F.when((n >= least) & (m > least), F.when(before > 0, after / before).otherwise(1.0))
    df = df.withColumn("f_stat", f).withColumn("f_p", F.when(F.col("f_stat").isNotNull(), f_p_two_sided("f_stat", m - 1, n - 1)))
    return df.withColumn("change_point", F.coalesce(F.col("f_p") < 0.01, F.lit(False))).drop("__k", "__m", "__n", "__v", "__d", "__i", "__s", "__q")


def f_regression(df: DataFrame, target: str, features: list[str], by: list[str]) -> DataFrame:
    """(by, feature, f, p): F of the regression of ``target`` on each feature alone, with its p-value."""
    pairs = [(n, F.col(n).isNotNull() & F.col(target).isNotNull()) for n in features]
    one = df.groupBy(*by).agg(*[F.corr(F.when(ok, c(n)), F.when(ok, c(target))).alias(f"__r_{n}") for n, ok in pairs], *[F.count_if(ok).alias(f"__n_{n}") for n, ok in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"__r_{n}").alias("r"), F.col(f"__n_{n}").alias("n")) for n in features]))
    flat = one.select(*by, rows.alias("__x")).select(*by, "__x.*")
    r2: Column = F.col("r") * F.col("r")
    return flat.select(*by, "feature", "n", ratio(r2 * (F.col("n") - 2), 1 - r2).alias("f")).select(*by, "feature", "f", f_p("f", F.lit(1), F.col("n") - 2).alias("p"))


def segment_stability(df: DataFrame, x: str, o: WindowSpec, segments: int, key: str = "k") -> DataFrame:
    """Spread of the means and deviations of ``segments`` equal parts of each key's rows, against their average size."""
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    part = F.floor((F.row_number().over(o) - 1) * segments / F.col("__n"))
    each = df.join(n, F.col(key) == F.col("__k")).withColumn("__p", part).groupBy(key, "__p").agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    spread = lambda v: ratio(F.stddev_samp(v), F.avg(F.abs(v)))
    return each.groupBy(key).agg(F.count("*").alias("segments"), spread("__m").alias("mean_spread"), spread("__s").alias("std_spread"))


def correlation(a: str, b: str) -> Column:
    """Pearson's r as an aggregate, null where either column is constant (rows must have both)."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def granger(df: DataFrame, x: str, y: str, o: WindowSpec, by: list[str]) -> DataFrame:
    """(by, x_to_y, y_to_x, and their p-values): F of one lag of the cause, given one lag of the effect.

    With one restriction F is (n - 3) p^2 / (1 - p^2), p the partial correlation, so six correlations in one
    aggregate do for both directions. Rows where any of the four values is null don't count; null below three degrees.
    """
    lagged = df.select(*by, c(x).alias("__x"), c(y).alias("__y"), F.lag(c(x)).over(o).alias("__a"), F.lag(c(y)).over(o).alias("__b")).dropna(subset=["__x", "__y", "__a", "__b"])
    r = lagged.groupBy(*by).agg(
        F.count("*").alias("__n"), correlation("__a", "__b").alias("__ab"), correlation("__y", "__a").alias("__ya"),
        correlation("__y", "__b").alias("__yb"), correlation("__x", "__a").alias("__xa"), correlation("__x", "__b").alias("__xb"),
    )

    def f(effect_cause: str, effect_own: str) -> Column:
        a, b, both = F.col(effect_cause), F.col(effect_own), F.col("__ab")
        p2 = ratio((a - b * both) * (a - b * both), (1 - b * b) * (1 - both * both))
        return F.when(F.col("__n") > 3, ratio((F.col("__n") - 3) * p2, 1 - p2))

    found = r.select(*by, "__n", f("__ya", "__yb").alias("x_to_y"), f("__xb", "__xa").alias("y_to_x"))
    p = lambda name: f_p(name, F.lit(1), F.col("__n") - 3).alias(f"{name}_p")
    return found.select(*by, "x_to_y", "y_to_x", p("x_to_y"), p("y_to_x"))


def two_components(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, share_1, share_2): variance shares of the two principal components of x and y (eigenvalues in closed form)."""
    both = df.where(c(x).isNotNull() & c(y).isNotNull()).groupBy(*by).agg(F.var_samp(x).alias("__a"), F.var_samp(y).alias("__b"), F.covar_samp(x, y).alias("__c"))
    total, gap = F.col("__a") + F.col("__b"), F.col("__a") - F.col("__b")
    first = ratio((total + F.sqrt(gap * gap + 4 * F.col("__c") * F.col("__c"))) / 2, total)
    return both.select(*by, first.alias("share_1"), (1 - first).alias("share_2"))


def arch_lm(df: DataFrame, r: str, o: WindowSpec, by: list[str]) -> DataFrame:
    """(by, n, lm, p): n times R^2 of squared centred returns on those before them."""
    o_key = Window.partitionBy(*by)
    d = df.where(c(r).isNotNull()).withColumn("__e", c(r) - F.avg(r).over(o_key)).withColumn("__q", F.col("__e") * F.col("__e"))
    d = d.withColumn("__l", F.lag("__q").over(o)).where("__l IS NOT NULL")
    rho = correlation("__q", "__l")
    return d.groupBy(*by).agg(F.count("*").alias("n"), (F.count("*") * rho * rho).alias("lm")).withColumn("p", chi2_p("lm", F.lit(1)))


def equal_variance(df: DataFrame, x: str, group: str, by: list[str]) -> DataFrame:
    """(by, levene, bartlett, f_ratio) of groups 1 and 0; Levene's by distances to the group's median."""
    values = df.where(c(x).isNotNull() & c(group).isin(0, 1))
    middle = values.groupBy(*by, group).agg(F.median(x).alias("__m"))
    away = values.join(middle, [*by, group]).withColumn("__z", F.abs(c(x) - F.col("__m")))
    one, two = F.col(group) == 1, F.col(group) == 0
    s = away.groupBy(*by).agg(
        F.count_if(one).alias("n1"), F.count_if(two).alias("n0"), F.var_samp(F.when(one, c(x))).alias("v1"), F.var_samp(F.when(two, c(x))).alias("v0"),
        F.avg(F.when(one, F.col("__z"))).alias("m1"), F.avg(F.when(two, F.col("__z"))).alias("m0"), F.avg("__z").alias("m"),
        F.var_samp(F.when(one, F.col("__z"))).alias("w1"), F.var_samp(F.when(two, F.col("__z"))).alias("w0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    free = n1 + n0 - 2
    between = n1 * (F.col("m1") - F.col("m")) * (F.col("m1") - F.col("m")) + n0 * (F.col("m0") - F.col("m")) * (F.col("m0") - F.col("m"))
    levene = ratio(free * between, (n1 - 1) * F.col("w1") + (n0 - 1) * F.col("w0"))
    pooled = ((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / F.nullif(free, F.lit(0))
    spread = free * F.ln(pooled) - (n1 - 1) * F.ln("v1") - (n0 - 1) * F.ln("v0")
    bartlett = spread / (1 + (1 / F.nullif(n1 - 1, F.lit(0)) + 1 / F.nullif(n0 - 1, F.lit(0)) - 1 / F.nullif(free, F.lit(0))) / 3)
    found = s.select(*by, levene.alias("levene"), bartlett.alias("bartlett"), ratio("v1", "v0").alias("f_ratio"), "n1", "n0")
    p = {"levene_p": f_p("levene", F.lit(1), free), "bartlett_p": chi2_p("bartlett", F.lit(1)), "f_ratio_p": f_p_two_sided("f_ratio", n1 - 1, n0 - 1)}
    return found.select(*by, "levene", "bartlett", "f_ratio", *[v.alias(name) for name, v in p.items()])


def ljung_box(df: DataFrame, x: str, o: WindowSpec, lags: int, by: list[str]) -> DataFrame:
    """(by, n, q, p): n (n + 2) times the sum over lags of the squared autocorrelation over n - lag."""
    d = df.where(c(x).isNotNull()).withColumn("__d", c(x) - F.avg(x).over(Window.partitionBy(*by)))
    d = d.select(*by, "__d", *[F.lag("__d", j).over(o).alias(f"__{j}") for j in range(1, lags + 1)])
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("__v"), *[F.sum(F.col("__d") * F.col(f"__{j}")).alias(f"__c{j}") for j in range(1, lags + 1)])
    n, total = F.col("n"), F.lit(0.0)
    for j in range(1, lags + 1):
        rho = ratio(F.col(f"__c{j}"), "__v")
        total = total + F.coalesce(rho * rho / F.nullif(n - j, F.lit(0)), F.lit(0.0))
    return s.select(*by, "n", (n * (n + 2) * total).alias("q")).withColumn("p", chi2_p("q", F.lit(lags)))


def equal_bins(df: DataFrame, x: str, bins: int, by: list[str], name: str) -> DataFrame:
    """Adds ``name``: which of ``bins`` parts of equal width between the key's least and greatest value x falls in."""
    o = Window.partitionBy(*by)
    low, high = F.min(x).over(o), F.max(x).over(o)
    at = F.least(F.floor((c(x) - low) * bins / F.nullif(high - low, F.lit(0.0))), F.lit(bins - 1))
    return df.withColumn(name, F.when(c(x).isNotNull(), F.coalesce(at, F.lit(0))))


def mutual_information(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, mi) in nats between two binned columns: cell counts, then windows over the cells (bins squared a key)."""
    cells = pairs.where(c(a).isNotNull() & c(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("__c"))
    total = lambda *keys: F.sum("__c").over(Window.partitionBy(*by, *keys))
    each = cells.withColumns({"__n": total(), "__a": total(a), "__b": total(b)})
    p = F.col("__c") / F.col("__n")
    return each.groupBy(*by).agg(F.sum(p * F.ln(F.col("__c") * F.col("__n") / (F.col("__a") * F.col("__b")))).alias("mi"))


def likeness(df: DataFrame, columns: list[str], group: str, by: list[str]) -> DataFrame:
    """(by, feature, similarity): 1 less the relative differences of mean and deviation of group 1 from group 0, 0 at least each."""
    one, two = F.col(group) == 1, F.col(group) == 0
    s = df.groupBy(*by).agg(*[f(F.when(g, c(n))).alias(f"__{m}_{n}") for n in columns for m, f, g in (("m0", F.avg, two), ("m1", F.avg, one), ("s0", F.stddev_samp, two), ("s1", F.stddev_samp, one))])
    near = lambda n, v: F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"__{v}0_{n}") - F.col(f"__{v}1_{n}")) / (F.abs(F.col(f"__{v}0_{n}")) + 1e-8))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), ((near(n, "m") + near(n, "s")) / 2).alias("similarity")) for n in columns]))
    return s.select(*by, rows.alias("__x")).select(*by, "__x.*")


def normality(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, n, jarque_bera, jarque_bera_p, dagostino, dagostino_p) from skewness and kurtosis, in one aggregate.

    D'Agostino's statistic adds the squares of the normalised skewness and kurtosis (Anscombe's for the latter). Null under
    eight rows or without spread.
    """
    s = df.where(c(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.skewness(x).alias("__g1"), F.kurtosis(x).alias("__g2"), F.stddev_pop(x).alias("__s"))
    n = F.col("n").cast("double")
    ok = (F.col("n") >= 8) & (F.col("__s") > 0)
    y = F.col("__g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    s = s.withColumn("__w2", F.when(ok, F.sqrt(2 * (beta - 1)) - 1)).withColumn("__y", F.when(ok, y))
    scale = F.col("__y") / F.sqrt(2 / (F.col("__w2") - 1))
    z1 = F.ln(scale + F.sqrt(scale * scale + 1)) / F.sqrt(F.ln(F.sqrt("__w2")))
    mean = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    s = s.withColumn("__a", F.when(ok, 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))))
    part = (1 - 2 / F.col("__a")) / (1 + (F.col("__g2") + 3 - mean) / F.sqrt(spread) * F.sqrt(2 / (F.col("__a") - 4)))
    z2 = (1 - 2 / (9 * F.col("__a")) - F.cbrt(part)) / F.sqrt(2 / (9 * F.col("__a")))
    jb = F.when(ok, n / 6 * (F.col("__g1") * F.col("__g1") + F.col("__g2") * F.col("__g2") / 4))
    s = s.select(*by, "n", jb.alias("jarque_bera"), (z1 * z1 + z2 * z2).alias("dagostino"))
    p = lambda name: chi2_p(name, F.lit(2)).alias(f"{name}_p")
    return s.select(*by, "n", "jarque_bera", p("jarque_bera"), "dagostino", p("dagostino"))


def curvature(df: DataFrame, x: str, o: WindowSpec, by: list[str], least: int = 30) -> DataFrame:
    """(by, n, lm, p): squared residuals of x on x before it (through the origin) on that value, its square and its cube.

    n times R^2 against chi-square of three degrees; R^2 is about the mean, as the regression has no constant it can be
    negative, which tells nothing (p 1). Values are scaled to their greatest size, which changes no fit. Null under ``least`` rows.
    """
    size = F.max(F.abs(x)).over(Window.partitionBy(*by))
    d = df.where(c(x).isNotNull()).select("*", ratio(x, size).alias("__y")).withColumn("__l", F.lag("__y").over(o)).where("__l IS NOT NULL AND __y IS NOT NULL")
    slope = d.groupBy(*by).agg(ratio(F.sum(F.col("__y") * F.col("__l")), F.sum(F.col("__l") * F.col("__l"))).alias("__b"))
    d = d.join(slope, by).withColumn("__e", (F.col("__y") - F.col("__b") * F.col("__l")) * (F.col("__y") - F.col("__b") * F.col("__l")))
    lag = F.col("__l")
    xx, xy, yy = moments([lag, lag * lag, lag * lag * lag], F.col("__e"))
    s = d.groupBy(*by).agg(F.count("*").alias("n"), xx.alias("__xx"), xy.alias("__xy"), yy.alias("__yy"), (F.var_pop("__e") * F.count("*")).alias("__t"))
    b, _ = solve(F.col("__xx"), F.col("__xy"))
    s = s.withColumn("__c", b)
    lm = F.col("n") * (1 - ratio(F.col("__yy") - dot(F.col("__c"), F.col("__xy")), "__t"))
    return s.select(*by, "n", F.when(F.col("n") >= least - 1, lm).alias("lm")).withColumn("p", chi2_p(F.when(F.col("lm").isNotNull(), F.greatest("lm", F.lit(0.0))), F.lit(3)))


def conditional_entropy(df: DataFrame, x: str, y: str, bins: int, by: list[str]) -> DataFrame:
    """(by, conditional_entropy) in bits of y given x, both in ``bins`` parts of equal width: H(x, y) - H(x) from the cells' counts."""
    d = equal_bins(equal_bins(df.where(c(x).isNotNull() & c(y).isNotNull()), x, bins, by, "__p"), y, bins, by, "__q")
    cells = d.groupBy(*by, "__p", "__q").agg(F.count("*").alias("__c"))
    cells = cells.withColumns({"__r": F.sum("__c").over(Window.partitionBy(*by, "__p")), "__n": F.sum("__c").over(Window.partitionBy(*by))})
    return cells.groupBy(*by).agg((-F.sum(F.col("__c") / F.col("__n") * F.log2(F.col("__c") / F.col("__r")))).alias("conditional_entropy"))
