"""Raw messages to typed ticks; the same columns work in batch and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c


def _number(path: str) -> Column:
    return F.get_json_object("payload", path).try_cast("double")


def _epoch_ms(path: str) -> Column:
    return F.timestamp_millis(F.get_json_object("payload", path).try_cast("long"))


def parse(raw: DataFrame) -> DataFrame:
    """(symbol, ts, price, volume, bid, ask, source, latency_ms) by each row's parser; unknown or broken messages have a null price."""
    kind = F.col("parser")

    def by(**parts: Column) -> Column:
        out = F
        for name, value in parts.items():
            out = out.when(kind == name, value)
        return out

    depth = lambda side, i: F.get_json_object("payload", f"$.{side}[0][{i}]").try_cast("double")
    text = lambda path: F.get_json_object("payload", path)
    return raw.select(
        by(binance_ticker=text("$.s"), binance_trades=text("$.s"), binance_depth=text("$.s"), coinbase_ticker=text("$.product_id"), generic=text("$.symbol")).alias("symbol"),
        F.coalesce(by(binance_ticker=_epoch_ms("$.E"), binance_trades=_epoch_ms("$.T"), binance_depth=_epoch_ms("$.E"), coinbase_ticker=F.try_to_timestamp(text("$.time")), generic=_epoch_ms("$.ts")), F.col("ingest_ts")).alias("ts"),
        by(binance_ticker=_number("$.c"), binance_trades=_number("$.p"), binance_depth=(depth("b", 0) + depth("a", 0)) / 2, coinbase_ticker=_number("$.price"), generic=_number("$.price")).alias("price"),
        by(binance_ticker=_number("$.v"), binance_trades=_number("$.q"), coinbase_ticker=_number("$.volume_24h"), generic=_number("$.volume")).alias("volume"),
        by(binance_ticker=_number("$.b"), binance_depth=depth("b", 0), coinbase_ticker=_number("$.best_bid")).alias("bid"),
        by(binance_ticker=_number("$.a"), binance_depth=depth("a", 0), coinbase_ticker=_number("$.best_ask")).alias("ask"),
        "source", "ingest_ts",
    ).withColumn("latency_ms", (F.unix_micros("ingest_ts") - F.unix_micros("ts")) / 1000)


def errors(price: str = "price", volume: str = "volume", ts: str = "ts", now: str = "ingest_ts", most_age: int = 300) -> Column:
    """The reasons for which a tick is not valid, an empty array if it is."""
    return F.array_compact(F.array(
        F.when(c(price).isNull(), "no price"), F.when(~c(price).between(10_000, 200_000), "price out of bounds"),
        F.when(~c(volume).between(0, 1e9), "volume out of bounds"), F.when(F.unix_timestamp(now) - F.unix_timestamp(ts) > most_age, "too old"),
    ))
