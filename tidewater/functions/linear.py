"""Least squares in columns: normal equations from one aggregate, solved by elimination inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, c, let


def moments(columns: list[Column], y: Column, aggregate=F.sum) -> tuple[Column, Column, Column]:
    """X'X as rows, X'y and y'y, from sums (or running sums: pass another ``aggregate``) of products."""
    k = len(columns)
    upper = {(i, j): aggregate(columns[i] * columns[j]) for i in range(k) for j in range(i, k)}
    xx = F.array(*[F.array(*[upper[min(i, j), max(i, j)] for j in range(k)]) for i in range(k)])
    return xx, F.array(*[aggregate(x * y) for x in columns]), aggregate(y * y)


def eliminated(rows: Column, k: Column | int) -> Column:
    """Gauss-Jordan on the first k columns of a matrix (array of rows) with a positive definite left part; null where it is singular."""

    def step(m: Column, i: Column) -> Column:
        def cleared(pivot: Column) -> Column:
            head = F.get(pivot, i)
            unit = F.transform(pivot, lambda x: x / F.nullif(head, F.lit(0.0)))
            return let(lambda unit: F.transform(m, lambda row, r: F.when(r == i, unit).otherwise(let(lambda f: F.zip_with(row, unit, lambda x, u: x - f * u), F.get(row, i)))), unit)

        return let(cleared, F.get(m, i))

    last = k - 1 if isinstance(k, Column) else F.lit(k - 1)
    return F.aggregate(F.sequence(F.lit(0), last.cast("int")), rows, step)


def solve(xx: Column, xy: Column, ridge: ColumnLike | float = 0.0) -> tuple[Column, Column]:
    """(coefficients, diagonal of the inverse) of (X'X + ridge I) b = X'y.

    ``ridge`` is added to all diagonal entries but the first (the constant's).
    """
    penalty = ridge if isinstance(ridge, Column) else F.lit(float(ridge)) if not isinstance(ridge, str) else c(ridge)
    k = F.size(xx)

    def wide(row: Column, i: Column) -> Column:
        left = F.transform(row, lambda x, j: x + F.when((i == j) & (i > 0), penalty).otherwise(0.0))
        unit = F.transform(row, lambda _, j: F.when(i == j, 1.0).otherwise(0.0))
        return F.concat(left, F.array(F.get(xy, i)), unit)

    done = eliminated(F.transform(xx, wide), k)
    return F.transform(done, lambda row: F.get(row, k)), F.transform(done, lambda row, i: F.get(row, k + 1 + i))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
