"""Streaming pipelines: windows, late data, deduplication, metrics, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..session import shared_dir
from .parse import errors, parse


def file_stream(spark: SparkSession, folder: str, schema: str = schemas.EVENTS, per_trigger: int = 1, names: str = "*.parquet") -> DataFrame:
    """A folder's Parquet files as a stream; ``per_trigger`` files a batch (back-pressure, nothing is dropped)."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", names).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def kafka_stream(spark: SparkSession, servers: str, topic: str, parser: str = "generic", **options: str) -> DataFrame:
    """Messages of a topic as raw rows (source, parser, payload, ingest_ts)."""
    df = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest"} | options).load()
    return df.select(F.col("topic").alias("source"), F.lit(parser).alias("parser"), F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("ingest_ts"))


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None, **options: str) -> StreamingQuery:
    """Rows of a stream as gzipped JSON messages of a topic, keyed by ``key``; the checkpoint lets it go on where it stopped."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    rows = df.select(value) if key is None else df.select(F.col(key).cast("string").alias("key"), value)
    return rows.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.compression.type": "gzip", "checkpointLocation": checkpoint} | options).start()


def valid_ticks(raw: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Parsed, validated ticks; rows later than ``late`` and repeats within it are dropped by the watermark."""
    ticks = parse(raw).withColumn("errors", errors()).where(F.size("errors") == 0)
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts", "source"])


def windowed_bars(ticks: DataFrame, size: str = "1 minute", slide: str | None = None, late: str = "5 minutes", key: str = "symbol", x: str = "price") -> DataFrame:
    """OHLC and counts by tumbling or sliding window."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = ticks.withWatermark("ts", late).groupBy(window.alias("w"), F.col(key).alias("k")).agg(
        F.min_by(x, "ts").alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, "ts").alias("close"), F.count("*").alias("n")
    )
    return found.select("k", F.col("w.start").alias("t"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col(key).alias("k")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("k", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def rate_alerts(events: DataFrame, most: int = 10, size: str = "10 minutes", slide: str = "1 minute", key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Keys with more than ``most`` events in a sliding window."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return found.select("k", F.col("w.start").alias("t"), "n")


def quality_metrics(batch: DataFrame) -> DataFrame:
    """Freshness, completeness, variation and latency of a batch by source."""
    return batch.groupBy("source").agg(
        F.count("*").alias("n"), F.max("ts").alias("newest"), (F.count("price") / F.count("*")).alias("completeness"),
        (F.stddev_pop("price") / F.nullif(F.avg("price"), F.lit(0.0))).alias("variation"), F.avg("latency_ms").alias("latency_ms"),
    )


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, table: str | None = None, path: str | None = None, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Starts one query: to a function by batch, a table, or a folder; without ``every`` it takes what there is and ends.

    The checkpoint makes file and table sinks exactly-once; a function gets (batch, id) and should overwrite by id.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if sink is not None:
        return writer.foreachBatch(sink).start()
    if table is not None:
        return writer.toTable(table)
    return writer.format("parquet").start(path)


def joined(trades: DataFrame, quotes: DataFrame, within: str = "10 minutes", late: str = "30 minutes", key: str = "k", how: str = "inner") -> DataFrame:
    """Each trade with the quotes of its key in the ``within`` before it (or at its time): two-sided state, bounded by both watermarks.

    ``trades`` has (key, ts, price), ``quotes`` (key, ts, quote). Rows of either side later than ``late`` are dropped. The time
    bound tells Spark when a row can meet no more partner, so state goes once the other side's watermark has passed. With
    ``how`` "leftOuter" a trade without a quote comes out, with nulls, when its time is over. Works on batches alike.
    """
    a = trades.select(F.col(key).alias("k"), F.col("ts").alias("trade_ts"), "price").withWatermark("trade_ts", late)
    b = quotes.select(F.col(key).alias("k"), F.col("ts").alias("quote_ts"), "quote").withWatermark("quote_ts", late)
    near = (F.col("a.k") == F.col("b.k")) & (F.col("quote_ts") <= F.col("trade_ts")) & (F.col("quote_ts") >= F.col("trade_ts") - F.expr(f"interval {within}"))
    return a.alias("a").join(b.alias("b"), near, how).select("a.k", "trade_ts", "price", "quote_ts", "quote")


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into a folder of its own in the shared one, and gives what came out as a table."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/tidewater-streams/{uuid.uuid4().hex}"
    run(stream, f"{at}/checkpoint", path=f"{at}/rows", mode=mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
