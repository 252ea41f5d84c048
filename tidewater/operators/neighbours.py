"""Pairs of vectors within a radius, and what series analysis counts with them.

A pair is found by an equi-join on grid cells as wide as the radius: projections of two
vectors differ by no more than their distance, so they fall in the same or in adjoining cells.
One side goes to its own cell, the other to all around it. Cells with many rows are split, so
no cell is one task's work; the rows around them go to each part.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, ratio
from ..functions.linear import dot

#: Rows of a cell that stay together.
CELL_ROWS = 1000


def projections(v: Column, size: int, dims: int, metric: str) -> list[Column]:
    """``dims`` numbers of a vector that differ by no more than the distance of two vectors.

    Coordinates will do for both metrics; long vectors under the Euclidean one are added up with the signs of
    Walsh functions, which tell them apart better than a few of their coordinates.
    """
    if metric == "max" or size <= dims:
        return [F.get(v, F.lit(j)) for j in range(min(dims, size))]
    signs = [F.array(*[F.lit((-1.0) ** bin(i & (j + 1)).count("1") / size**0.5) for i in range(size)]) for j in range(dims)]
    return [dot(v, s) for s in signs]


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "max":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def neighbour_pairs(df: DataFrame, id_col: str, vector: str, size: int, radius: float, by: list[str] = (), metric: str = "max", dims: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(by, a, b, distance): all pairs a < b of ids whose vectors of ``size`` numbers are closer than ``radius``, each once.

    Metrics: "max" (greatest difference) and "euclid". Rows whose vector is null or has a null don't count.
    """
    own = df.select(*by, F.col(id_col).alias("__id"), F.transform(vector, lambda x: x.cast("double")).alias("__v"))
    own = own.where(F.col("__v").isNotNull() & ~F.exists("__v", lambda x: x.isNull()))
    cells = [f"__c{j}" for j in range(min(dims, size))]
    own = own.select("*", *[F.floor(p / radius).alias(name) for p, name in zip(projections(F.col("__v"), size, dims, metric), cells, strict=True)])
    parts = own.groupBy(*by, *cells).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("__parts"))
    keys = [*by, *cells]
    left = own.join(parts, keys).withColumn("__part", F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int"))
    around = F.explode(F.array(*[F.struct(*[(F.col(name) + step).alias(name) for name, step in zip(cells, steps, strict=True)]) for steps in product((-1, 0, 1), repeat=len(cells))]))
    right = own.select(*by, "__id", "__v", around.alias("__x")).select(*by, F.col("__id").alias("b"), F.col("__v").alias("__w"), "__x.*")
    right = right.join(parts, keys).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    found = left.select(*keys, "__part", F.col("__id").alias("a"), "__v").join(right, [*keys, "__part"])
    found = found.where(F.col("a") < F.col("b")).select(*by, "a", "b", distance(F.col("__v"), F.col("__w"), metric).alias("distance"))
    return found.where(F.col("distance") < radius)


def delay_vectors(df: DataFrame, x: str, o: WindowSpec, m: int, key: str = "k") -> DataFrame:
    """(key, i, v, n): row number, x and the m - 1 values after it in the key's population deviations, and the vectors of the key.

    Rows without a value are left out first. A key of constant x has no vectors.
    """
    all_rows = Window.partitionBy(key)
    d = df.where(c(x).isNotNull()).select(key, F.row_number().over(o).alias("i"), *[F.lead(x, j).over(o).alias(f"__{j}") for j in range(m)], F.stddev_pop(x).over(all_rows).alias("__s"), (F.count("*").over(all_rows) - (m - 1)).alias("n"))
    return d.where((F.col("__s") > 0) & F.col(f"__{m - 1}").isNotNull()).select(key, "i", F.array(*[F.col(f"__{j}") / F.col("__s") for j in range(m)]).alias("v"), "n")


def recurrence(df: DataFrame, x: str, o: WindowSpec, m: int = 3, radius: float = 0.1, key: str = "k") -> DataFrame:
    """(key, n, recurrence_rate, determinism, average_diagonal, longest_diagonal) of the recurrence plot of x.

    Points are vectors of m values, near if closer (Euclid) than ``radius`` deviations. The plot is symmetric: pairs count
    twice, and the main diagonal is one line of n points. Lines are runs of pairs (i, j), (i + 1, j + 1), ..; those of two
    points and more count for determinism and the average. ``longest_diagonal`` leaves the main one out.
    """
    v = delay_vectors(df, x, o, m, key)
    pairs = neighbour_pairs(v, "i", "v", m, radius, [key], "euclid")
    o_line = Window.partitionBy(key, "__off").orderBy("a")
    pairs = pairs.withColumn("__off", F.col("b") - F.col("a"))
    lines = pairs.withColumn("__line", F.col("a") - F.row_number().over(o_line)).groupBy(key, "__off", "__line").agg(F.count("*").alias("__l"))
    long = F.col("__l") >= 2
    s = lines.groupBy(key).agg(F.sum("__l").alias("__p"), F.sum(F.when(long, F.col("__l"))).alias("__in"), F.count_if(long).alias("__lines"), F.max("__l").alias("__m"))
    n = v.groupBy(key).agg(F.max("n").alias("n"))
    f = n.join(s, key, "left").na.fill(0, ["__p", "__in", "__lines", "__m"])
    count = F.col("n")
    points = count + 2 * F.col("__p")
    return f.select(key, "n", (points / (count * count)).alias("recurrence_rate"), ((count + 2 * F.col("__in")) / points).alias("determinism"), ((count + 2 * F.col("__in")) / (1 + 2 * F.col("__lines"))).alias("average_diagonal"), F.col("__m").alias("longest_diagonal"))


def correlation_sums(df: DataFrame, x: str, o: WindowSpec, m: int, radii: list[float], key: str = "k") -> DataFrame:
    """(key, n, radius, share): the share of all pairs of m-value vectors closer (greatest difference) than each radius, in deviations.

    One join at the largest radius; its pairs are counted for all radii at once.
    """
    v = delay_vectors(df, x, o, m, key)
    pairs = neighbour_pairs(v, "i", "v", m, max(radii), [key], "max")
    counts = pairs.groupBy(key).agg(*[F.count_if(F.col("distance") < r).alias(f"__{j}") for j, r in enumerate(radii)])
    wide = v.groupBy(key).agg(F.max("n").alias("n")).join(counts, key, "left").na.fill(0, [f"__{j}" for j in range(len(radii))])
    rows = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"__{j}").alias("pairs")) for j, r in enumerate(radii)]))
    share = ratio("__x.pairs", F.col("n") * (F.col("n") - 1) / 2)
    return wide.withColumn("__x", rows).select(key, "n", "__x.radius", share.alias("share"))


def correlation_dimension(df: DataFrame, x: str, o: WindowSpec, m: int = 5, radii: list[float] = (0.2, 0.3, 0.4, 0.5, 0.6), key: str = "k") -> DataFrame:
    """(key, dimension): slope of the log share of near pairs on the log radius, over the radii that have pairs."""
    sums = correlation_sums(df, x, o, m, list(radii), key).where("share > 0")
    return sums.groupBy(key).agg(F.regr_slope(F.ln("share"), F.ln("radius")).alias("dimension"))


def bds(df: DataFrame, x: str, o: WindowSpec, radius: float = 0.5, key: str = "k") -> DataFrame:
    """(key, bds): root of the pairs times the gap between the share of near pairs of two-value vectors and its square."""
    s = correlation_sums(df, x, o, 2, [radius], key)
    return s.select(key, (F.sqrt(F.col("n") * (F.col("n") - 1) / 2) * F.abs(F.col("share") - F.col("share") * F.col("share"))).alias("bds"))


def lyapunov_proxy(df: DataFrame, x: str, o: WindowSpec, t: str = "t", key: str = "k", least: float = 1e-10) -> DataFrame:
    """(key, lyapunov): mean log ratio of successive absolute changes, where both exceed ``least``."""
    step = c(x) - F.lag(x).over(o)
    d = df.where(c(x).isNotNull()).select(key, t, step.alias("__d"))
    d = d.withColumn("__e", F.lag("__d").over(o))
    size, before = F.abs("__d"), F.abs("__e")
    return d.groupBy(key).agg(F.avg(F.when((size > least) & (before > least), F.ln(size / before))).alias("lyapunov"))


def zero_one(df: DataFrame, x: str, o: WindowSpec, t: str = "t", phase: float = 1.7, key: str = "k") -> DataFrame:
    """(key, zero_one): the 0-1 test's mean squared displacement over n at a fixed phase, held between 0 and 1."""
    n = F.count("*").over(Window.partitionBy(key))
    d = df.where(c(x).isNotNull()).select(key, t, (c(x) - F.avg(x).over(Window.partitionBy(key))).alias("__d"), (F.row_number().over(o) * phase).alias("__a"), n.alias("__n"))
    so_far = o.rowsBetween(Window.unboundedPreceding, 0)
    p, q = F.sum(F.col("__d") * F.cos("__a")).over(so_far), F.sum(F.col("__d") * F.sin("__a")).over(so_far)
    m = d.select(key, ((p * p + q * q) / F.col("__n")).alias("__m"))
    return m.groupBy(key).agg(F.least(F.greatest(F.avg("__m"), F.lit(0.0)), F.lit(1.0)).alias("zero_one"))


def _log_shares(df: DataFrame, x: str, o: WindowSpec, m: int, radius: float, key: str) -> DataFrame:
    """(key, phi, pairs): the mean log share of vectors near each vector (itself among them), and the pairs."""
    v = delay_vectors(df, x, o, m, key)
    pairs = neighbour_pairs(v, "i", "v", m, radius, [key], "max")
    near = pairs.select(key, F.explode(F.array("a", "b")).alias("i")).groupBy(key, "i").agg(F.count("*").alias("__c"))
    share = (1 + F.coalesce("__c", F.lit(0))) / F.col("n")
    each = v.select(key, "i", "n").join(near, [key, "i"], "left")
    return each.groupBy(key).agg(F.avg(F.ln(share)).alias("phi"), (F.sum(F.coalesce("__c", F.lit(0))) / 2).alias("pairs"))


def pair_entropies(df: DataFrame, x: str, o: WindowSpec, m: int = 2, radius: float = 0.2, key: str = "k") -> DataFrame:
    """(key, approximate, sample): how much less likely stretches of m values that are near stay near for one more.

    Approximate entropy is the difference of the mean log shares, sample entropy the log ratio of the pairs (null where
    no pair of the longer ones is near). Two joins, no matrix.
    """
    short, long = _log_shares(df, x, o, m, radius, key), _log_shares(df, x, o, m + 1, radius, key)
    both = short.select(key, F.col("phi").alias("__p"), F.col("pairs").alias("__b")).join(long.select(key, "phi", "pairs"), key)
    return both.select(key, (F.col("__p") - F.col("phi")).alias("approximate"), (-F.ln(F.nullif(F.col("pairs"), F.lit(0.0)) / F.nullif(F.col("__b"), F.lit(0.0)))).alias("sample"))


def multiscale_entropy(df: DataFrame, x: str, o: WindowSpec, scales: list[int], m: int = 2, radius: float = 0.2, key: str = "k") -> DataFrame:
    """(key, scale, sample): sample entropy of the means of each ``scale`` rows in a row; an incomplete last group is left out."""
    out = None
    rows = df.where(c(x).isNotNull()).select(key, c(x).alias("__x"), (F.row_number().over(o) - 1).alias("__i"))
    for scale in scales:
        coarse = rows.groupBy(key, F.floor(F.col("__i") / scale).alias("__i")).agg(F.avg("__x").alias("__x"), F.count("*").alias("__n")).where(F.col("__n") == scale)
        one = pair_entropies(coarse, "__x", Window.partitionBy(key).orderBy("__i"), m, radius, key).select(key, F.lit(scale).alias("scale"), "sample")
        out = one if out is None else out.unionByName(one)
    return out
