"""Pattern vectors, similarity and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def window_vectors(x: Column, o: WindowSpec, k: int) -> Column:
    """The last k values as an array, null while fewer are there."""
    held = F.collect_list(x).over(o.rowsBetween(-(k - 1), 0))
    return F.when(F.size(held) == k, held)


def similar_windows(df: DataFrame, x: str, o: WindowSpec, k: int, least: float, top: int, key: str = "k", t: str = "t") -> DataFrame:
    """For each key the ``top`` past windows most like its current one, with the next k-step outcome.

    The current window is one row a key, so the join is on the key and small on one side.
    """
    df = df.withColumn("__v", window_vectors(c(x), o, k)).withColumn("outcome", F.lead(x, 1).over(o))
    now = df.where("__v IS NOT NULL").groupBy(key).agg(F.max_by("__v", t).alias("__now"), F.max(t).alias("__t"))
    found = df.join(now, key).where(F.col(t) < F.col("__t")).withColumn("similarity", cosine(F.col("__v"), F.col("__now")))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), t))
    return found.where(F.col("similarity") > least).withColumn("rank", best).where(F.col("rank") <= top).select(key, t, "rank", "similarity", "outcome")


def nearest_vectors(df: DataFrame, target: DataFrame, id_col: str, vector: str, top: int) -> DataFrame:
    """The ``top`` rows of ``df`` closest by cosine to the single vector in ``target`` (vector column ``__target``)."""
    one = target.select("__target", F.lit(1).alias("__j"))
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    found = df.withColumn("__j", F.lit(1)).join(F.broadcast(one), "__j").select(id_col, cosine(v, F.col("__target")).alias("similarity"))
    return found.orderBy(F.desc("similarity"), id_col).limit(top)
