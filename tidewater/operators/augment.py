"""Series made from series: noise, stretched values, stretched time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .fill import forward


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 (both out) from the parts' digest: the same in every run, task and partitioning."""
    digest = F.md5(F.concat_ws("|", *[x.cast("string") for x in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2**32


def noise(df: DataFrame, columns: list[str], row: Column, level: float = 0.01, seed: int = 0, key: str = "k") -> DataFrame:
    """Adds normal noise of ``level`` standard deviations of the key's column. ``row`` tells a key's rows apart.

    Rows of equal key and ``row`` get equal noise; a lost task draws the same again. Missing values stay; a single value gets none.
    """
    spread = df.groupBy(F.col(key).alias("__k")).agg(*[F.stddev_samp(n).alias(f"__{n}") for n in columns])

    def normal(n: str) -> Column:
        one, two = (uniform(F.lit(seed), F.lit(n), F.lit(i), F.coalesce(F.col(key).cast("string"), F.lit("")), row) for i in (0, 1))
        return F.sqrt(-2 * F.ln(one)) * F.cos(2 * math.pi * two)

    both = df.join(spread, F.col(key).eqNullSafe(F.col("__k")), "left")
    return both.withColumns({n: F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0.0)) * level * normal(n) for n in columns}).drop("__k", *[f"__{n}" for n in columns])


def magnitude(df: DataFrame, columns: list[str], o: WindowSpec, factor: float = 1.05, key: str = "k") -> DataFrame:
    """Distances from the key's mean times ``factor``; missing values take the last one first."""
    filled = df.withColumns({n: forward(n, o) for n in columns})
    means = filled.groupBy(F.col(key).alias("__k")).agg(*[F.avg(n).alias(f"__{n}") for n in columns])
    both = filled.join(means, F.col(key).eqNullSafe(F.col("__k")), "left")
    return both.withColumns({n: (F.col(n) - F.col(f"__{n}")) * factor + F.col(f"__{n}") for n in columns}).drop("__k", *[f"__{n}" for n in columns])


def time_warp(df: DataFrame, columns: list[str], t: str, factor: float = 1.1, key: str = "k", least: int = 10) -> DataFrame:
    """(key, j, columns): each key's rows read at n / ``factor`` evenly spaced places (``least`` at least), linear between rows.

    Keys of fewer than ``least`` rows keep their rows. A row gives the places between itself and the next one, so nothing is
    joined. Where either neighbour is missing the place is missing.
    """
    o, every = Window.partitionBy(key).orderBy(t), Window.partitionBy(key)
    n, i = F.col("__n"), F.col("__i")
    rows = df.select(key, *columns, (F.row_number().over(o) - 1).cast("long").alias("__i"), F.count("*").over(every).alias("__n"), *[F.lead(x).over(o).alias(f"__{x}") for x in columns])
    m = F.when(n < least, n).otherwise(F.greatest(F.lit(least), F.floor(n / F.lit(float(factor))))).cast("long")
    rows = rows.withColumn("__m", m)
    steps, gaps = F.col("__m") - 1, F.greatest(n - 1, F.lit(1))
    first = F.expr("(__i * (__m - 1) + greatest(__n - 1, 1) - 1) div greatest(__n - 1, 1)")
    last = F.when(i == n - 1, steps).otherwise(F.expr("((__i + 1) * (__m - 1) + greatest(__n - 1, 1) - 1) div greatest(__n - 1, 1) - 1"))
    rows = rows.withColumns({"__a": first, "__z": last}).where("__a <= __z").withColumn("j", F.explode(F.sequence("__a", "__z")))
    part = (F.col("j") * gaps - i * steps) / F.greatest(steps, F.lit(1))
    return rows.select(key, "j", *[F.when(part == 0, F.col(x)).otherwise(F.col(x) + part * (F.col(f"__{x}") - F.col(x))).alias(x) for x in columns])
