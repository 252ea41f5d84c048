"""Unit-root and stationarity tests: a lagged regression from one aggregate, and a long-run variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, ratio, running
from ..functions.linear import dot, moments, solve

#: Coefficients on 1, 1/n, 1/n^2 and 1/n^3 of the critical values at 1, 5 and 10 %, without and with a trend.
CRITICAL = {
    "c": {"1": (-3.43035, -6.5393, -16.786, -79.433), "5": (-2.86154, -2.8903, -4.234, -40.040), "10": (-2.56677, -1.5384, -2.809, 0.0)},
    "ct": {"1": (-3.95877, -9.0531, -28.428, -134.155), "5": (-3.41049, -4.3904, -9.036, -45.374), "10": (-3.12705, -2.5856, -3.925, -22.380)},
}
#: The level statistic's tail probabilities.
KPSS_TAIL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def unit_root(df: DataFrame, x: str, o: WindowSpec, by: list[str], lags: int = 1, trend: str = "c") -> DataFrame:
    """(by, n, adf, critical_1, critical_5, critical_10, is_stationary): the augmented Dickey-Fuller test.

    The change of x is regressed on x before it, ``lags`` changes before it, a constant and, with ``trend`` "ct",
    the row number; ``adf`` is the t of the first. Rows without a value are left out before lagging. Null where x or
    its changes are constant, or fewer than three rows stay beyond the coefficients.
    """
    level = c(x) - F.avg(x).over(Window.partitionBy(*by))  # the constant takes the mean; small numbers keep the sums exact
    d = df.where(c(x).isNotNull()).select("*", level.alias("__x")).withColumns({"__y": F.lag("__x").over(o), "__i": F.row_number().over(o).cast("double")})
    d = d.withColumn("__d", F.col("__x") - F.col("__y"))
    before = {f"__d{j}": F.lag("__d", j).over(o) for j in range(1, lags + 1)}
    d = d.withColumns(before).dropna(subset=["__y", "__d", *before])
    columns = [F.lit(1.0), F.col("__y"), *([F.col("__i")] if trend == "ct" else []), *map(F.col, before)]
    k = len(columns)
    xx, xy, yy = moments(columns, F.col("__d"))
    sums = d.groupBy(*by).agg(F.count("*").alias("n"), xx.alias("__xx"), xy.alias("__xy"), yy.alias("__yy"), F.stddev_pop("__y").alias("__sy"), F.stddev_pop("__d").alias("__sd"))
    b, inverse = solve(F.col("__xx"), F.col("__xy"))
    solved = sums.withColumns({"__b": b, "__inv": inverse})
    rest = (F.col("__yy") - dot(F.col("__b"), F.col("__xy"))) / (F.col("n") - k)
    t = ratio(F.get("__b", F.lit(1)), F.sqrt(F.when(rest > 0, rest) * F.get("__inv", F.lit(1))))
    usable = (F.col("n") >= k + 3) & (F.col("__sy") > 1e-12) & (F.col("__sd") > 1e-12)
    found = solved.select(*by, "n", F.when(usable, t).alias("adf"))

    def critical(level: str) -> Column:
        a, b1, b2, b3 = CRITICAL[trend][level]
        n = F.col("n")
        return F.when(F.col("adf").isNotNull(), a + b1 / n + b2 / (n * n) + b3 / (n * n * n))

    found = found.withColumns({f"critical_{level}": critical(level) for level in ("1", "5", "10")})
    return found.withColumn("is_stationary", F.col("adf") < F.col("critical_5"))


def kpss(df: DataFrame, x: str, o: WindowSpec, by: list[str], lags: int = 12) -> DataFrame:
    """(by, n, kpss, p, is_stationary): squared running sums of the deviations over n^2 long-run variances.

    The long-run variance takes ``lags`` autocovariances with Bartlett's weights. p is read off the table between 0.1
    and 0.01 and held there. Null on constant x and on fewer rows than the lags and two more.
    """
    d = df.where(c(x).isNotNull()).select("*", (c(x) - F.avg(x).over(Window.partitionBy(*by))).alias("__e"))
    d = d.withColumns({"__s": running("sum", "__e", o)} | {f"__{j}": F.lag("__e", j).over(o) for j in range(1, lags + 1)})
    e = F.col("__e")
    sums = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("__s") * F.col("__s")).alias("__q"), F.sum(e * e).alias("__v"), *[F.coalesce(F.sum(e * F.col(f"__{j}")), F.lit(0.0)).alias(f"__{j}") for j in range(1, lags + 1)])
    n, long_run = F.col("n"), F.col("__v")
    for j in range(1, lags + 1):
        long_run = long_run + 2 * (1 - j / (lags + 1)) * F.col(f"__{j}")
    stat = F.when((n >= lags + 2) & (F.col("__v") > 1e-12) & (long_run > 0), F.col("__q") / (n * long_run))
    found = sums.select(*by, "n", stat.alias("kpss"))
    p = F.when(F.col("kpss") <= KPSS_TAIL[0][0], KPSS_TAIL[0][1])
    for (a, pa), (b, pb) in zip(KPSS_TAIL, KPSS_TAIL[1:], strict=False):
        p = p.when(F.col("kpss") <= b, pa + (F.col("kpss") - a) * (pb - pa) / (b - a))
    p = p.when(F.col("kpss").isNotNull(), KPSS_TAIL[-1][1])
    return found.withColumn("p", p).withColumn("is_stationary", F.col("p") > 0.05)
