"""Upserts, merges and long-format writes, as DataFrame transforms plus thin writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "new") -> DataFrame:
    """The union in which, for equal keys, the new rows win (``keep`` "old": the old ones)."""
    both = old.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)), allowMissingColumns=True)
    order = F.desc("__b") if keep == "new" else F.asc("__b")
    return latest(both, keys, [order]).drop("__b")


def retained(df: DataFrame, key: str, t: str, rows: int) -> DataFrame:
    """The last ``rows`` rows of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(t)))).where(F.col("__rn") <= rows).drop("__rn")


def counted_upsert(old: DataFrame, new: DataFrame, keys: list[str], counter: str = "usage_count") -> DataFrame:
    """New keys start at 1, known ones add the times they come again."""
    times = new.groupBy(*keys).agg(F.count("*").alias("__n"))
    joined = old.select(*keys, F.col(counter).alias("__o")).join(times, keys, "full")
    return joined.select(*keys, (F.coalesce("__o", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias(counter))


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature_name", value: str = "value") -> DataFrame:
    """Long format without nulls."""
    return df.unpivot(ids, columns, name, value).where(F.col(value).isNotNull())


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet by partition; with dynamic overwrite only the partitions in ``df`` are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest_within(df: DataFrame, keys: list[str], at: str, now, seconds: int = 300) -> DataFrame:
    """Each key's latest row, as long as it is no older than ``seconds`` at ``now`` (a column or a time): a cache with a time to live."""
    moment = now if isinstance(now, Column) else F.lit(now)
    rest = [x for x in df.columns if x not in keys]
    last = df.groupBy(*keys).agg(F.max(F.struct(at, *[x for x in rest if x != at])).alias("__l")).select(*keys, "__l.*").select(*df.columns)
    return last.where(F.unix_timestamp(at) >= F.unix_timestamp(moment) - seconds)
