"""Distribution functions as Column expressions: gamma, beta, normal, t, F and chi-square.

Continued fractions and series run inside ``aggregate``, so an expression stays small however
many terms it takes. About 1e-12 of the true value up to some millions of degrees of freedom
(the terms grow with their root, to at most ``MOST_TERMS``). Null in, null out; arguments out
of range give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, c, let

MOST_TERMS = 20_000
_TINY = 1e-300


def _held(x: Column) -> Column:
    """x, kept away from zero for a continued fraction's divisions."""
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def log_gamma(x: ColumnLike) -> Column:
    """ln of gamma of x > 0: Stirling's series ten places further on."""

    def stirling(z: Column) -> Column:
        y, z2 = z + 10, (z + 10) * (z + 10)
        series = (1 / F.lit(12.0) - (1 / F.lit(360.0) - (1 / F.lit(1260.0) - (1 / F.lit(1680.0) - 1 / (1188.0 * z2)) / z2) / z2) / z2) / y
        back = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + F.ln(z + i))
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - back

    return let(stirling, c(x).cast("double"))


def _terms(size: Column) -> Column:
    return F.sequence(F.lit(1), F.least(F.lit(60) + F.ceil(5 * F.sqrt(size)), F.lit(MOST_TERMS)).cast("int"))


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function (converges fast for x < (a + 1) / (a + b + 2))."""

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def half(aa: Column, s: Column) -> Column:
            d, k = 1 / _held(1 + aa * s["d"]), _held(1 + aa / s["c"])
            return let(lambda d, k: F.struct(k.alias("c"), d.alias("d"), (s["h"] * d * k).alias("h")), d, k)

        return let(lambda s: half(odd, s), half(even, s))

    d0 = 1 / _held(1 - (a + b) * x / (a + 1))
    start = let(lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), d0)
    return F.aggregate(_terms(F.greatest(a, b)), start, step, lambda s: s["h"])


def beta_cdf(x: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""

    def of(x: Column, a: Column, b: Column) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
        near = front * _beta_fraction(x, a, b) / a
        far = 1 - front * _beta_fraction(1 - x, b, a) / b
        inside = F.when(x < (a + 1) / (a + b + 2), near).otherwise(far)
        return F.when((a <= 0) | (b <= 0), None).when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), inside)

    return let(of, *[c(v).cast("double") for v in (x, a, b)])


def gamma_tail(a: ColumnLike, x: ColumnLike) -> Column:
    """The regularised upper incomplete gamma function Q(a, x)."""

    def of(a: Column, x: Column) -> Column:
        front = F.exp(-x + a * F.ln(x) - log_gamma(a))
        start = let(lambda t: F.struct(t.alias("t"), t.alias("s")), 1 / a)
        grow = lambda s, n: let(lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s")), s["t"] * x / (a + n))
        series = 1 - front * F.aggregate(_terms(F.greatest(a, x)), start, grow, lambda s: s["s"])

        def step(s: Column, i: Column) -> Column:
            an, b = -i * (i - a), x + 1 - a + 2 * i
            return let(lambda d, k: F.struct(k.alias("c"), d.alias("d"), (s["h"] * d * k).alias("h")), 1 / _held(an * s["d"] + b), _held(b + an / s["c"]))

        begin = let(lambda d: F.struct(F.lit(1 / _TINY).alias("c"), d.alias("d"), d.alias("h")), 1 / _held(x + 1 - a))
        fraction = front * F.aggregate(_terms(F.greatest(a, x)), begin, step, lambda s: s["h"])
        return F.when(a <= 0, None).when(x <= 0, 1.0).when(x == float("inf"), 0.0).when(x < a + 1, series).when(x.isNotNull(), fraction)

    return let(of, *[c(v).cast("double") for v in (a, x)])


def t_p(t: ColumnLike, df: ColumnLike) -> Column:
    """Two-sided p-value of Student's t."""
    return let(lambda t, n: beta_cdf(n / (n + t * t), n / 2, F.lit(0.5)), c(t).cast("double"), c(df).cast("double"))


def f_p(f: ColumnLike, d1: ColumnLike, d2: ColumnLike) -> Column:
    """Upper p-value of F."""
    return let(lambda f, m, n: beta_cdf(F.when(f > 0, n / (n + m * f)).when(f.isNotNull(), 1.0), n / 2, m / 2), *[c(v).cast("double") for v in (f, d1, d2)])


def f_p_two_sided(f: ColumnLike, d1: ColumnLike, d2: ColumnLike) -> Column:
    return let(lambda p: 2 * F.least(p, 1 - p), f_p(f, d1, d2))


def chi2_p(x: ColumnLike, df: ColumnLike) -> Column:
    """Upper p-value of chi-square."""
    return gamma_tail(c(df) / 2, c(x) / 2)


def normal_p(z: ColumnLike) -> Column:
    """Two-sided p-value of a standard normal value."""
    return gamma_tail(F.lit(0.5), c(z) * c(z) / 2)


def normal_cdf(z: ColumnLike) -> Column:
    return let(lambda z: F.when(z > 0, 1 - normal_p(z) / 2).otherwise(normal_p(z) / 2), c(z).cast("double"))


#: A published rational approximation of the normal quantile (nine digits), centre and tail.
_CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141468968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for v in coefficients[1:]:
        out = out * x + v
    return out


def normal_quantile(p: ColumnLike) -> Column:
    """The z below which a share p of the standard normal lies; infinite at 0 and 1."""

    def of(p: Column) -> Column:
        tail = lambda p: let(lambda q: _poly(_TAIL[0], q) / _poly(_TAIL[1], q), F.sqrt(-2 * F.ln(p)))
        centre = let(lambda q: q * _poly(_CENTRE[0], q * q) / _poly(_CENTRE[1], q * q), p - 0.5)
        rough = F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(centre)

        def better(x: Column, _: Column) -> Column:  # Halley's step
            return let(lambda u: x - u / (1 + x * u / 2), (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2))

        fine = F.aggregate(F.sequence(F.lit(1), F.lit(2)), rough, better)
        return F.when((p < 0) | (p > 1), None).when(p == 0, float("-inf")).when(p == 1, float("inf")).when(p.isNotNull(), fine)

    return let(of, c(p).cast("double"))
