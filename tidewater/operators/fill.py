"""Missing data: fills, interpolation, continuity, decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, so_far


def forward(x: str, o: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(so_far(o))


def backward(x: str, o: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(o.rowsBetween(0, Window.unboundedFollowing))


def interpolate(df: DataFrame, x: str, o: WindowSpec, position: Column | None = None) -> DataFrame:
    """Fills nulls of x on the line between the neighbouring values, by row number or ``position``.

    Edges take the nearest value.
    """
    df = df.withColumn("__n", (F.row_number().over(o) if position is None else position).cast("double"))
    known = F.when(c(x).isNotNull(), F.col("__n"))
    before, after = so_far(o), o.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({
        "__px": F.last(x, ignorenulls=True).over(before), "__pn": F.last(known, ignorenulls=True).over(before),
        "__nx": F.first(x, ignorenulls=True).over(after), "__nn": F.first(known, ignorenulls=True).over(after),
    })
    line = F.col("__px") + (F.col("__nx") - F.col("__px")) * (F.col("__n") - F.col("__pn")) / F.nullif(F.col("__nn") - F.col("__pn"), F.lit(0.0))
    value = F.when(c(x).isNotNull(), c(x)).when(F.col("__px").isNull(), F.col("__nx")).when(F.col("__nx").isNull(), F.col("__px")).otherwise(line)
    return df.withColumn(x, value).drop("__n", "__px", "__pn", "__nx", "__nn")


def seasonal(df: DataFrame, x: str, o: WindowSpec, period: int, key: str = "k") -> DataFrame:
    """Fills nulls with the mean of the same phase."""
    df = df.withColumn("__ph", F.row_number().over(o) % period)
    return df.withColumn(x, F.coalesce(x, F.avg(x).over(Window.partitionBy(key, "__ph")))).drop("__ph")


def continuity(df: DataFrame, step: int, key: str = "k", t: str = "t") -> DataFrame:
    """Per key: rows, breaks longer than ``step`` seconds, the longest and usual gap, covered share."""
    o = Window.partitionBy(key).orderBy(t)
    gaps = df.select(key, (F.unix_timestamp(t) - F.unix_timestamp(F.lag(t).over(o))).alias("s"))
    return gaps.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("s") > step).alias("breaks"), F.max("s").cast("double").alias("longest"),
        F.mode("s", True).cast("double").alias("usual"), (F.count("*") / (F.sum(F.coalesce("s", F.lit(step))) / step)).alias("coverage"),
    )


def decompose(df: DataFrame, x: str, o: WindowSpec, period: int, key: str = "k") -> DataFrame:
    """Additive trend (clamped centred mean), seasonal part (mean by phase) and residual."""
    df = df.withColumn("trend", F.avg(x).over(o.rowsBetween(-(period // 2), period // 2))).withColumn("__ph", (F.row_number().over(o) - 1) % period)
    df = df.withColumn("seasonal", F.avg(c(x) - F.col("trend")).over(Window.partitionBy(key, "__ph"))).drop("__ph")
    return df.withColumn("residual", c(x) - F.col("trend") - F.col("seasonal"))


def by_null_ratio(df: DataFrame, columns: list[str], o: WindowSpec) -> DataFrame:
    """Adaptive fill: under 5 % nulls interpolate, under 20 % carry forward, else the median; one aggregate decides."""
    shares = df.agg(*[(F.count_if(F.col(x).isNull()) / F.count("*")).alias(x) for x in columns], *[F.median(x).alias(f"{x}__m") for x in columns]).collect()[0]
    for x in columns:
        if shares[x] and shares[x] < 0.05:
            df = interpolate(df, x, o)
        elif shares[x] and shares[x] < 0.2:
            df = df.withColumn(x, F.coalesce(forward(x, o), backward(x, o)))
        elif shares[x]:
            df = df.withColumn(x, F.coalesce(x, F.lit(shares[f"{x}__m"])))
    return df


def extrapolate(df: DataFrame, x: str, o: WindowSpec, key: str = "k") -> DataFrame:
    """As ``interpolate`` by row number, but nulls before the first and after the last value follow the line
    through the two nearest values. A key with one value repeats it; one without stays null."""
    df = df.withColumn("__i", F.row_number().over(o).cast("double"))
    at = F.when(c(x).isNotNull(), F.struct(F.col("__i").alias("i"), c(x).alias("v")))
    held = df.where(c(x).isNotNull()).select(key, at.alias("__p"), F.row_number().over(o).alias("__u"), F.count("*").over(Window.partitionBy(key)).alias("__n"))
    pick = lambda m: F.min(F.when(m, F.col("__p")))
    ends = held.where("__u <= 2 OR __u > __n - 2").groupBy(F.col(key).alias("__k")).agg(
        pick(F.col("__u") == 1).alias("__a"), pick(F.col("__u") == 2).alias("__b"), pick(F.col("__u") == F.col("__n") - 1).alias("__y"), pick(F.col("__u") == F.col("__n")).alias("__z")
    )
    line = lambda p, q, base: F.col(f"{base}.v") + (F.col("__i") - F.col(f"{base}.i")) * (F.col(f"{q}.v") - F.col(f"{p}.v")) / F.nullif(F.col(f"{q}.i") - F.col(f"{p}.i"), F.lit(0.0))
    df = interpolate(df.withColumn("__x", c(x)), "__x", o).join(ends, F.col(key) == F.col("__k"), "left")
    value = F.when(F.col("__i") < F.col("__a.i"), line("__a", "__b", "__a")).when(F.col("__i") > F.col("__z.i"), line("__y", "__z", "__z"))
    return df.withColumn(x, F.coalesce(c(x), value, F.col("__x"))).drop("__i", "__x", "__k", "__a", "__b", "__y", "__z")


def local_line(df: DataFrame, x: str, o: WindowSpec, share: float = 0.3, key: str = "k") -> DataFrame:
    """Adds trend: at row i (from 0) the line through the origin fitted to the rows at most half of h = ceil(share n)
    away, weighted by 1 - distance / h.

    The weights are linear on either side of i, so each side needs only sums of j x, j^2 x, j^2 and j^3. Running sums, looked
    up at the window's ends by a join on the row number, give them: work grows with the rows, not with rows times window.
    """
    df = df.where(c(x).isNotNull())
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    df = df.withColumn("__i", (F.row_number().over(o) - 1).cast("long"))
    j, sums = F.col("__i").cast("double"), o.rowsBetween(Window.unboundedPreceding, 0)
    terms = {"__p1": j * c(x), "__p2": j * j * c(x), "__q1": j * j, "__q2": j * j * j}
    df = df.withColumns({name: F.sum(v).over(sums) for name, v in terms.items()})
    at = lambda tag: df.select(F.col(key).alias(f"__k{tag}"), F.col("__i").alias(f"__i{tag}"), *[F.col(p).alias(f"{p}{tag}") for p in terms])
    df = df.join(n, F.col(key) == F.col("__k")).withColumn("__h", F.ceil(share * F.col("__n"))).withColumn("__w", F.floor(F.col("__h") / 2))
    df = df.withColumns({"__lo": F.col("__i") - F.col("__w") - 1, "__hi": F.least(F.col("__i") + F.col("__w"), F.col("__n") - 1)})
    df = df.join(at("_s"), (F.col(key) == F.col("__k_s")) & (F.col("__lo") == F.col("__i_s")), "left")
    df = df.join(at("_e"), (F.col(key) == F.col("__k_e")) & (F.col("__hi") == F.col("__i_e")), "left")

    def weighted(one: str, two: str) -> Column:
        left = [F.col(s) - F.coalesce(f"{s}_s", F.lit(0.0)) for s in (one, two)]  # rows from lo + 1 to i
        right = [F.col(f"{s}_e") - F.col(s) for s in (one, two)]  # rows from i + 1 to hi
        h = F.col("__h")
        return left[0] * (1 - F.col("__i") / h) + left[1] / h + right[0] * (1 + F.col("__i") / h) - right[1] / h

    slope = weighted("__p1", "__p2") / F.nullif(weighted("__q1", "__q2"), F.lit(0.0))
    df = df.withColumn("trend", F.coalesce(slope * F.col("__i"), c(x)))
    return df.drop(*[n for n in df.columns if n.startswith("__")])


def knn_windows(df: DataFrame, x: str, o: WindowSpec, window: int = 48, k: int = 5, block: int = 512, key: str = "k", t: str = "t") -> DataFrame:
    """(key, t, filled): x, a missing one replaced by the mean of the ``k`` rows that end the most similar windows.

    Similar: the Euclidean distance over the places that both windows of ``window`` rows have, scaled up to the whole
    window (ties: the earlier row). Only rows that end a whole window are filled; where no window shares a place with the
    row's, the mean of all windows' last values is taken, and a key without any stays null. The rows to fill meet the
    others in blocks of ``block`` rows, of which each sends on its ``k`` best.
    """
    held = F.collect_list(F.struct(F.col(x).cast("double").alias("x"))).over(o.rowsBetween(-(window - 1), 0))
    d = df.select(key, t, F.col(x).cast("double").alias("__x"), F.row_number().over(o).alias("__i"), held.alias("__v"))
    ends = d.where(F.size("__v") == window).select(key, t, "__x", F.floor(F.col("__i") / block).alias("__block"), F.transform("__v", lambda s: s["x"]).alias("__v"))
    donors = ends.where("__x IS NOT NULL")
    wanted = ends.where("__x IS NULL").select(key, F.col(t).alias("__t"), F.col("__v").alias("__w"))
    gap = F.zip_with("__v", "__w", lambda a, b: (a - b) * (a - b))
    both = F.filter(gap, lambda g: g.isNotNull())
    near = F.struct(F.round(F.aggregate(both, F.lit(0.0), lambda s, g: s + g) * window / F.size(both), 9).alias("d"), F.col(t).alias("at"), F.col("__x").alias("x"))
    best = lambda rows: F.slice(F.array_sort(rows), 1, k)
    pairs = donors.join(wanted, key).where(F.exists(gap, lambda g: g.isNotNull()))
    some = pairs.groupBy(key, "__t", "__block").agg(best(F.collect_list(near)).alias("__n"))
    top = some.groupBy(key, "__t").agg(best(F.flatten(F.collect_list("__n"))).alias("__n"))
    mean = F.aggregate("__n", F.lit(0.0), lambda s, r: s + r["x"]) / F.size("__n")
    usual = donors.groupBy(key).agg(F.avg("__x").alias("__m"))
    found = wanted.select(key, "__t").join(top.select(key, "__t", mean.alias("__f")), [key, "__t"], "left").join(usual, key, "left")
    found = found.select(key, F.col("__t").alias(t), F.coalesce("__f", "__m").alias("__fill"))
    return d.select(key, t, "__x").join(found, [key, t], "left").select(key, t, F.coalesce("__x", "__fill").alias("filled"))
