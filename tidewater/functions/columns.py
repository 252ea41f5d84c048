"""Column helpers with the semantics of series libraries.

Every function takes and returns Columns and stays inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ColumnLike = Column | str


def c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nz(x: ColumnLike) -> Column:
    """Null instead of zero, for divisors."""
    return F.nullif(c(x), F.lit(0.0))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, null where b is zero."""
    return c(a) / nz(b)


def clip(x: ColumnLike, low: float | Column, high: float | Column) -> Column:
    """x held between the bounds; null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(c(x).isNotNull(), F.least(F.greatest(c(x), low), high))


def finite(x: ColumnLike) -> Column:
    """Null instead of infinity and NaN."""
    return F.when(~F.isnan(c(x)) & (F.abs(c(x)) != float("inf")), c(x))


def flag(condition: Column) -> Column:
    return condition.cast("double")


def rows(order: WindowSpec, k: int, until: int = 0) -> WindowSpec:
    """The frame of the k rows that end ``until`` rows before the current one."""
    return order.rowsBetween(-(k - 1) - until, -until)


def so_far(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: ColumnLike, frame: WindowSpec, k: int) -> Column:
    """``value`` where the frame holds k values of x, else null (``min_periods`` = k)."""
    return F.when(F.count(c(x)).over(frame) == k, value)


def sma(x: ColumnLike, order: WindowSpec, k: int) -> Column:
    f = rows(order, k)
    return full(F.avg(c(x)).over(f), x, f, k)


def rolling(name: str, x: ColumnLike, order: WindowSpec, k: int) -> Column:
    """A rolling aggregate by name: sum, min, max, std (ddof 1), var, std0 (ddof 0), var0, median."""
    f = rows(order, k)
    agg = {"sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "std0": F.stddev_pop, "var0": F.var_pop, "median": F.median}[name]
    return full(agg(c(x)).over(f), x, f, k)


def rolling_quantile(x: ColumnLike, order: WindowSpec, k: int, q: float) -> Column:
    """Exact, with linear interpolation."""
    f = rows(order, k)
    return full(F.percentile(c(x), F.lit(q)).over(f), x, f, k)


def sample_skewness(x: ColumnLike, n: Column) -> Column:
    """Bias-corrected factor on the population skewness of n values; apply to F.skewness(x)."""
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2)) * c(x)


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one of n values."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def rolling_skew(x: ColumnLike, order: WindowSpec, k: int) -> Column:
    f = rows(order, k)
    spread = F.stddev_pop(c(x)).over(f) > 0
    return full(F.when(spread, sample_skewness(F.skewness(c(x)).over(f), F.lit(k))), x, f, k)


def rolling_kurt(x: ColumnLike, order: WindowSpec, k: int) -> Column:
    f = rows(order, k)
    spread = F.stddev_pop(c(x)).over(f) > 0
    return full(F.when(spread, sample_kurtosis(F.kurtosis(c(x)).over(f), F.lit(k))), x, f, k)


def rolling_pct_rank(x: ColumnLike, order: WindowSpec, k: int) -> Column:
    """Rank of the row's value within its window, ties averaged, as a share of k."""
    f = rows(order, k)
    held = F.collect_list(c(x)).over(f)
    below = F.size(F.filter(held, lambda v: v < c(x)))
    equal = F.size(F.filter(held, lambda v: v == c(x)))
    return full((below + (equal + 1) / 2) / k, x, f, k)


def change(x: ColumnLike, order: WindowSpec, n: int = 1) -> Column:
    return c(x) - F.lag(c(x), n).over(order)


def pct_change(x: ColumnLike, order: WindowSpec, n: int = 1) -> Column:
    return c(x) / nz(F.lag(c(x), n).over(order)) - 1


def log_return(x: ColumnLike, order: WindowSpec) -> Column:
    return F.ln(c(x) / nz(F.lag(c(x)).over(order)))


def running(name: str, x: ColumnLike, order: WindowSpec) -> Column:
    agg = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}[name]
    return agg(c(x)).over(so_far(order))


def running_product(growth: ColumnLike, order: WindowSpec) -> Column:
    """Product of (1 + growth) so far, for growth above -1."""
    return F.exp(F.sum(F.ln(1 + F.coalesce(c(growth), F.lit(0.0)))).over(so_far(order)))


def islands(start: Column, order: WindowSpec) -> Column:
    """Number of the run a row is in, given a flag for rows that start one."""
    return F.sum(start.cast("int")).over(so_far(order))


def rolling_central_moment(x: ColumnLike, order: WindowSpec, k: int, power: int) -> Column:
    """The mean of the window's deviations to a power of 3 or 4."""
    f = rows(order, k)
    spread = F.stddev_pop(c(x)).over(f)
    shape = F.skewness(c(x)).over(f) if power == 3 else F.kurtosis(c(x)).over(f) + 3
    return full(F.when(spread > 0, shape * F.pow(spread, F.lit(power))).otherwise(0.0), x, f, k)


def median_filter(x: ColumnLike, order: WindowSpec, k: int = 5) -> Column:
    """The median of k rows around each; at the ends the nearest rows stand again, mirrored."""
    half = k // 2
    held = _mirrored(x, order, half)
    return F.when(c(x).isNotNull(), F.get(F.array_sort(held), F.lit(half)))


def gaussian_filter(x: ColumnLike, order: WindowSpec, sigma: float = 1.0, reach: float = 4.0) -> Column:
    """The mean of the rows around each by a bell of ``sigma`` rows, cut off at ``reach`` sigmas; the ends are mirrored."""
    half = int(reach * sigma + 0.5)
    taps = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-half, half + 1)]
    weights = F.array(*[F.lit(t / sum(taps)) for t in taps])
    held = _mirrored(x, order, half)
    return F.when(c(x).isNotNull(), F.aggregate(F.zip_with(held, weights, lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v))


def let(f: Callable[..., Column], *values: Column) -> Column:
    """f of the values, each worked out once however often f uses it."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda s: f(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def _mirrored(x: ColumnLike, order: WindowSpec, half: int) -> Column:
    """The rows from ``half`` before to ``half`` after; what is beyond an end is read back from it, the end row twice."""
    before = [F.lag(c(x), j).over(order) for j in range(half, 0, -1)]
    after = [F.lead(c(x), j).over(order) for j in range(1, half + 1)]
    number = F.row_number().over(order)
    count = F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def read(row: Column, i: Column, n: Column) -> Column:
        def place(j: Column) -> Column:  # row p of the series (from 0) stands at p - i + 1 + half
            p = F.pmod(i - 1 + j - half, 2 * n)
            return F.when(p < n, p).otherwise(2 * n - 1 - p) - i + 1 + half

        return F.transform(F.sequence(F.lit(0), F.lit(2 * half)), lambda j: F.get(row, place(j).cast("int")))

    return let(read, F.array(*before, c(x), *after), number, count)
