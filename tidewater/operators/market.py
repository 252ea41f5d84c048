"""Trades, order books, transfers, funding and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, clip, ratio

# Trade sizes from which a bucket begins.
SIZE_BUCKETS = ((10.0, "retail"), (25.0, "small"), (40.0, "medium"))
# Depths of a book, in percent of the mid price.
DEPTHS = (0.1, 0.5, 1.0, 2.0, 5.0)


def vwap(price: str = "price", size: str = "size") -> Column:
    return F.sum(c(price) * c(size)) / F.greatest(F.sum(size), F.lit(1.0))


def size_bucket(size: str = "size", steps: tuple[tuple[float, str], ...] = SIZE_BUCKETS, top: str = "whale") -> Column:
    out = F
    for bound, name in steps:
        out = out.when(c(size) < bound, name)
    return out.otherwise(top)


def size_buckets(trades: DataFrame, by: list[str]) -> DataFrame:
    """Count, volume, share of volume and buy ratio by size bucket."""
    found = trades.groupBy(*by, size_bucket().alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("size").alias("volume"), vwap().alias("vwap"), (F.sum(F.when(F.col("side") == "buy", F.col("size")).otherwise(0.0)) / F.sum("size")).alias("buy_ratio")
    )
    return found.withColumn("share", F.col("volume") / F.sum("volume").over(Window.partitionBy(*by)))


def flow(trades: DataFrame, by: list[str]) -> DataFrame:
    """Buy, sell and net volume, aggressive ratio and size-weighted direction."""
    buy, sell = F.sum(F.when(F.col("side") == "buy", F.col("size")).otherwise(0.0)), F.sum(F.when(F.col("side") == "sell", F.col("size")).otherwise(0.0))
    return trades.groupBy(*by).agg(
        buy.alias("buy_volume"), sell.alias("sell_volume"), (buy - sell).alias("net"), (buy / F.greatest(buy + sell, F.lit(1.0))).alias("buy_ratio"),
        F.avg((~F.col("is_maker")).cast("double")).alias("aggressive"),
        (F.sum(F.when(F.col("side") == "buy", 1.0).otherwise(-1.0) * F.col("size") * F.col("size")) / F.sum(F.col("size") * F.col("size"))).alias("weighted_direction"),
    )


def walk_book(levels: DataFrame, quantity: float, by: str, price: str = "price", size: str = "size", order: list[Column] | None = None) -> DataFrame:
    """Cost of taking ``quantity`` from the best level on; null average where the depth does not suffice."""
    w = Window.partitionBy(by).orderBy(*(order or [F.col(price)])).rowsBetween(Window.unboundedPreceding, 0)
    df = levels.withColumn("__before", F.sum(size).over(w) - F.col(size))
    fill = F.least(F.greatest(F.lit(quantity) - F.col("__before"), F.lit(0.0)), F.col(size))
    found = df.withColumn("__fill", fill).groupBy(by).agg(F.sum("__fill").alias("filled"), F.sum(F.col("__fill") * F.col(price)).alias("cost"), F.min(price).alias("best"))
    average = F.when(F.col("filled") >= quantity, F.col("cost") / quantity)
    return found.select(by, "filled", average.alias("average"), (average / F.col("best") - 1).alias("impact"))


def book_features(bids: str = "bids", asks: str = "asks") -> dict[str, Column]:
    """Spread, mid, microprice and depth imbalance of arrays of (price, size), best first."""
    bid, ask = F.get(bids, F.lit(0)), F.get(asks, F.lit(0))
    mid = (bid["price"] + ask["price"]) / 2
    depth = lambda side, keep: F.aggregate(F.filter(side, keep), F.lit(0.0), lambda a, x: a + x["size"])
    near_bid = depth(bids, lambda x: x["price"] >= mid * 0.99)
    near_ask = depth(asks, lambda x: x["price"] <= mid * 1.01)
    return {
        "spread": ask["price"] - bid["price"], "mid": mid, "spread_bps": ratio(ask["price"] - bid["price"], mid) * 10_000,
        "microprice": ratio(bid["price"] * ask["size"] + ask["price"] * bid["size"], bid["size"] + ask["size"]),
        "bid_depth": near_bid, "ask_depth": near_ask, "imbalance": ratio(near_bid - near_ask, near_bid + near_ask),
    }


def whale_flows(df: DataFrame, now: Column, hours: dict[str, int]) -> DataFrame:
    """In- and outflow within horizons before ``now``, by exchange, and the clipped net accumulation."""
    aggs = []
    for name, h in hours.items():
        recent = F.col("t") > now - F.make_dt_interval(hours=F.lit(h))
        for d in ("inflow", "outflow"):
            aggs.append(F.sum(F.when(recent & (F.col("direction") == d), F.col("amount")).otherwise(0.0)).alias(f"{d}_{name}"))
    total = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0.0))
    score = clip(ratio(total("outflow") - total("inflow"), total("outflow") + total("inflow")), -1.0, 1.0)
    return df.groupBy("exchange").agg(*aggs, score.alias("accumulation"))


def herfindahl(df: DataFrame, by: str, member: str, x: str) -> DataFrame:
    """Sum of squared shares of the members."""
    each = df.groupBy(by, member).agg(F.sum(x).alias("__s"))
    return each.groupBy(by).agg((F.sum(F.col("__s") * F.col("__s")) / (F.sum("__s") * F.sum("__s"))).alias("hhi"), F.count("*").alias("members"))


#: Venues whose pairs are formed at most; they are a dimension, and one copy of them is broadcast.
MAX_VENUES = 5_000


def pairwise_spread(df: DataFrame, name: str, x: str, least: float) -> DataFrame:
    """Pairs of venues whose x differs by more than ``least``; ``df`` has one row a venue, which a count checks."""
    if df.limit(MAX_VENUES + 1).count() > MAX_VENUES:
        raise ValueError(f"more than {MAX_VENUES} venues: their pairs are too many")
    a = df.select(F.col(name).alias("a"), F.col(x).alias("x"))
    b = df.select(F.col(name).alias("b"), F.col(x).alias("y"))
    return a.join(F.broadcast(b), (F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) > least)).select("a", "b", (F.col("x") - F.col("y")).alias("spread"))


def book_depth(levels: DataFrame, by: str, ask: str = "ask", price: str = "price", size: str = "size", steps: tuple[float, ...] = DEPTHS, top: int = 20) -> DataFrame:
    """(by, best_bid, best_ask, mid, bid_i, ask_i, imbalance_i for the i-th step, volume_imbalance, liquidity) of books of levels.

    A step is a percentage of the mid price: the depth reaches that far below the best bid and above the
    best ask. ``volume_imbalance`` takes the ``top`` levels of each side (of equal prices the larger first);
    ``liquidity`` is the depth at 1 % in hundreds, 1 at most. Aggregates only: a book of any number of levels
    is summed before the shuffle. Books without a side are left out; a null name is a book as well.
    """
    p, s, is_ask = F.col(price), F.col(size), F.col(ask)
    best = levels.groupBy(F.col(by).alias("__b")).agg(F.max(F.when(~is_ask, p)).alias("best_bid"), F.min(F.when(is_ask, p)).alias("best_ask"))
    best = best.where("best_bid IS NOT NULL AND best_ask IS NOT NULL").withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    both = levels.select(by, ask, price, size).join(best, F.col(by).eqNullSafe(F.col("__b")))
    total = lambda keep: F.coalesce(F.sum(F.when(keep, s)), F.lit(0.0))
    sums = [
        total(~is_ask & (p >= F.col("best_bid") - F.col("mid") * (x / 100))).alias(f"bid_{i}") for i, x in enumerate(steps)
    ] + [total(is_ask & (p <= F.col("best_ask") + F.col("mid") * (x / 100))).alias(f"ask_{i}") for i, x in enumerate(steps)]
    one = total(~is_ask & (p >= F.col("best_bid") - F.col("mid") * 0.01)) + total(is_ask & (p <= F.col("best_ask") + F.col("mid") * 0.01))
    depth = both.groupBy(by, "best_bid", "best_ask", "mid").agg(*sums, F.least(F.lit(1.0), one / 100).alias("liquidity"))
    share = lambda b, a: (b - a) / F.greatest(b + a, F.lit(1.0))
    depth = depth.withColumns({f"imbalance_{i}": share(F.col(f"bid_{i}"), F.col(f"ask_{i}")) for i in range(len(steps))})
    rank = F.row_number().over(Window.partitionBy(by, ask).orderBy(F.when(is_ask, p).otherwise(-p), F.desc(size)))
    first = levels.select(by, ask, price, size).withColumn("__r", rank).where(F.col("__r") <= top)
    sides = first.groupBy(F.col(by).alias("__b")).agg(share(total(~is_ask), total(is_ask)).alias("volume_imbalance"))
    return depth.join(sides, F.col(by).eqNullSafe(F.col("__b")), "left").drop("__b")


def market_quality(liquidity: Column, spread_bps: Column, volume: Column, stability: Column, absorption: Column) -> Column:
    """.3 liquidity, .25 efficiency (narrow spread, volume of a thousand), .25 stability and .2 absorption; unknown parts count 0."""
    efficiency = (F.greatest(F.lit(0.0), 1 - spread_bps / 50) + F.least(F.lit(1.0), volume / 1000)) / 2
    part = lambda x: F.coalesce(x, F.lit(0.0))
    return 0.3 * part(liquidity) + 0.25 * part(efficiency) + 0.25 * part(stability) + 0.2 * part(absorption)
