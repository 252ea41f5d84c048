"""File sources: indicator CSVs by name and category, JSON snapshots, tables, column resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import schemas

# Names tried in turn for the time and the price column.
TIME_COLUMNS = ("timestamp", "date", "time", "datetime")
PRICE_COLUMNS = ("close", "price", "btc_price", "market_price", "value")


def csv_series(spark: SparkSession, path: str, schema: str = schemas.INDICATOR_SERIES) -> DataFrame:
    """One or many CSVs with a header; ``path`` may be a glob."""
    return spark.read.schema(schema).option("header", True).csv(path)


def categories(spark: SparkSession, root: str) -> dict[str, str]:
    """The folders right under ``root`` by name: one listing of one level."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return {s.getPath().getName(): s.getPath().toString() for s in found if s.isDirectory() and s.getPath().getName()[0] not in "._"}


def indicator_files(spark: SparkSession, root: str, suffix: str = "_hourly.csv", contains: str | None = None, schema: str = schemas.INDICATOR_SERIES) -> DataFrame:
    """(ts, value, category, indicator) from ``root/category/name_hourly.csv``; file name filters prune files, not rows.

    The categories' folders become partitions of an external table, so a filter on ``category`` is a partition filter: the
    folders of other categories are neither listed nor read. The folders right under ``root`` are listed when this is called.
    """
    table = f"indicator_files_{uuid.uuid4().hex}"
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(f"CREATE TABLE {table} ({schema}, category string) USING csv OPTIONS (header 'true') PARTITIONED BY (category) LOCATION {quoted(root)}")
    if folders := categories(spark, root):
        spark.sql(f"ALTER TABLE {table} ADD " + " ".join(f"PARTITION (category = {quoted(name)}) LOCATION {quoted(at)}" for name, at in folders.items()))
    name = F.col("_metadata.file_name")  # a filter on it picks files before they are read
    wanted = name.endswith(suffix) & (name.contains(contains) if contains else F.lit(True))
    return spark.read.table(table).where(wanted).select("*", F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "").alias("indicator"))


def json_snapshots(spark: SparkSession, root: str, last: int = 168, prefix: str = "btc_analysis_") -> DataFrame:
    """(ts, document) of the newest ``last`` snapshot files; the time stands in the file's name."""
    docs = spark.read.option("wholetext", True).text(root).select(F.col("value").alias("document"), F.col("_metadata.file_name").alias("file"))
    stamp = F.regexp_extract("file", rf"{prefix}([0-9]{{4}}-?[0-9]{{2}}-?[0-9]{{2}}[T_ ]?[0-9]{{2}}:?[0-9]{{2}}:?[0-9]{{2}})", 1)
    digits = F.regexp_replace(stamp, "[^0-9]", "")
    names = docs.select("file").distinct().where(F.regexp_like("file", F.lit(prefix))).orderBy(F.desc("file")).limit(last)
    return docs.join(names, "file", "left_semi").select(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).alias("ts"), "document")


def table_or_jdbc(spark: SparkSession, name: str, url: str | None = None, **options: str) -> DataFrame:
    """A catalogue table, or one read over JDBC (with a partition column for parallel reads)."""
    if url is None:
        return spark.read.table(name)
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def time_column(df: DataFrame) -> str | None:
    low = {c.lower(): c for c in df.columns}
    return next((low[n] for n in TIME_COLUMNS if n in low), None)


def price_column(df: DataFrame, least_mean: float = 10_000.0) -> str | None:
    """The first known price name, else the first numeric column whose mean exceeds ``least_mean`` (one aggregate)."""
    low = {c.lower(): c for c in df.columns}
    if found := next((low[n] for n in PRICE_COLUMNS if n in low), None):
        return found
    columns = numeric_columns(df)
    if not columns:
        return None
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).collect()[0]
    return next((c for c in columns if means[c] is not None and means[c] > least_mean), None)
