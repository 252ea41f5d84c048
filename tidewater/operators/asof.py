"""Alignment of series, as-of and interval joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(frames: list[DataFrame], on: str) -> DataFrame:
    """Full outer alignment of a few wide series on one time column."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def align_long(df: DataFrame, on: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Alignment of many series kept long: one shuffle, whatever their number."""
    return df.groupBy(on).pivot(name, names).agg(F.first(value))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, forward: bool = False, tie: Column | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (``forward``: the first at or after).

    One sort by key and time over the union, no range join. Both sides have ``by`` and ``on``; the right side's
    other columns are added, null where there is no match. Right rows of equal time: the last by ``tie``.
    """
    added = [x for x in right.columns if x not in (*by, on)]
    payload = F.struct(*[F.col(x) for x in added])
    a = left.withColumn("__side", F.lit(1)).withColumn("__right", F.lit(None).cast(right.select(payload.alias("s")).schema["s"].dataType)).withColumn("__tie", F.lit(None).cast("string"))
    b = right.select(*by, on, F.lit(0).alias("__side"), payload.alias("__right"), (tie.cast("string") if tie is not None else F.lit(None).cast("string")).alias("__tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = [F.col(on).desc() if forward else F.col(on).asc(), F.col("__side"), F.col("__tie")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__m", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    return found.select(*left.columns, *[F.col(f"__m.{x}").alias(x) for x in added])


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, stop: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Points joined with the intervals [start, stop) that hold them, by equal keys and time buckets.

    An interval is entered in each bucket it touches, so the join stays an equi-join. Spark's size estimate knows
    nothing of these copies and would broadcast them all; both sides are shuffled and merged instead.
    """
    number = lambda x: F.floor(F.unix_timestamp(x) / bucket_seconds)
    spans = intervals.withColumn("__b", F.explode(F.sequence(number(start), number(stop))))
    return points.withColumn("__b", number(at)).join(spans.hint("merge"), [*by, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("__b")
