"""Technical indicators as columns over an ordered, keyed window.

``o`` is a window specification partitioned by key and ordered by time; columns are taken
by the names of bars (open, high, low, close, volume).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, change, flag, nz, pct_change, ratio, rolling, rows, sma, so_far


def gains_losses(x: Column | str, o: WindowSpec) -> tuple[Column, Column]:
    """Gain and loss of each step; the first row counts as 0 of both."""
    d = F.coalesce(change(x, o), F.lit(0.0))
    return F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))


def rsi_cutler(df: DataFrame, o: WindowSpec, k: int = 14, x: str = "close", out: str = "rsi") -> DataFrame:
    """RSI from simple means: 100 where there are no losses, null where there is no movement."""
    gain, loss = gains_losses(x, o)
    df = df.withColumn("__g", gain).withColumn("__l", loss)
    g, lo = sma("__g", o, k), sma("__l", o, k)
    value = F.when((lo == 0) & (g == 0), None).when(lo == 0, 100.0).otherwise(100 - 100 / (1 + g / nz(lo)))
    return df.withColumn(out, value).drop("__g", "__l")


def rsi_stream(df: DataFrame, o: WindowSpec, k: int = 14, x: str = "close", out: str = "rsi") -> DataFrame:
    """The streaming variant: 50 while short, 100 without losses."""
    df = df.withColumn("__d", change(x, o))
    f = rows(o, k)
    g, lo = F.avg(F.greatest("__d", F.lit(0.0))).over(f), F.avg(F.greatest(-F.col("__d"), F.lit(0.0))).over(f)
    value = F.when(F.count("__d").over(f) < k, 50.0).when(lo == 0, 100.0).otherwise(100 - 100 / (1 + g / nz(lo)))
    return df.withColumn(out, value).drop("__d")


def bollinger(x: str, o: WindowSpec, k: int = 20, width: float = 2.0, ddof: int = 1) -> dict[str, Column]:
    mid, dev = sma(x, o, k), rolling("std" if ddof else "std0", x, o, k)
    upper, lower = mid + width * dev, mid - width * dev
    return {"bb_mid": mid, "bb_upper": upper, "bb_lower": lower, "bb_width": ratio(upper - lower, mid), "bb_position": ratio(c(x) - lower, upper - lower)}


def stochastic(o: WindowSpec, k: int = 14) -> tuple[Column, Column]:
    """%K and Williams %R."""
    high, low = rolling("max", "high", o, k), rolling("min", "low", o, k)
    return 100 * ratio(c("close") - low, high - low), -100 * ratio(high - c("close"), high - low)


def true_range(o: WindowSpec) -> Column:
    before = F.lag("close").over(o)
    return F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))


def typical_price() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def cci(df: DataFrame, o: WindowSpec, k: int = 20, out: str = "cci") -> DataFrame:
    df = df.withColumn("__tp", typical_price())
    f = rows(o, k)
    mean = F.avg("__tp").over(f)
    df = df.withColumn("__m", mean).withColumn("__v", F.collect_list("__tp").over(f))
    deviation = F.expr("aggregate(__v, 0D, (a, v) -> a + abs(v - __m)) / size(__v)")
    return df.withColumn(out, F.when(F.size("__v") == k, ratio(c("__tp") - c("__m"), 0.015 * deviation))).drop("__tp", "__m", "__v")


def obv(o: WindowSpec) -> Column:
    return F.coalesce(F.signum(change("close", o)) * c("volume"), F.lit(0.0))


def pvt(o: WindowSpec) -> Column:
    return F.coalesce(pct_change("close", o) * c("volume"), F.lit(0.0))


def cumulative_vwap(o: WindowSpec, price: Column) -> Column:
    return F.sum(price * c("volume")).over(so_far(o)) / nz(F.sum("volume").over(so_far(o)))


def price_position(x: str, o: WindowSpec, k: int) -> Column:
    low, high = rolling("min", x, o, k), rolling("max", x, o, k)
    return ratio(c(x) - low, high - low)


def ichimoku(o: WindowSpec, conversion: int = 9, base: int = 26, span: int = 52) -> dict[str, Column]:
    mid = lambda k: (rolling("max", "high", o, k) + rolling("min", "low", o, k)) / 2
    a, b = mid(conversion), mid(base)
    return {"conversion": a, "base": b, "span_a": (a + b) / 2, "span_b": mid(span)}


def candle_columns() -> dict[str, Column]:
    body, size = F.abs(c("close") - c("open")), c("high") - c("low")
    upper = c("high") - F.greatest("open", "close")
    lower = F.least("open", "close") - c("low")
    return {
        "body_ratio": ratio(body, size), "upper_shadow": ratio(upper, size), "lower_shadow": ratio(lower, size),
        "doji": F.coalesce(flag(ratio(body, size) < 0.1), F.lit(0.0)),
        "hammer": flag((lower > 2 * body) & (upper < 0.5 * body) & (body > 0)),
        "shooting_star": flag((upper > 2 * body) & (lower < 0.5 * body) & (body > 0)),
    }


def calendar(t: str = "t") -> dict[str, Column]:
    """Calendar features; Monday is 0."""
    hour, dow, month = F.hour(t), F.weekday(t), F.month(t)
    wave = lambda x, period: 2 * math.pi * x / period
    return {
        "hour": hour, "dow": dow, "month": month, "quarter": F.quarter(t),
        "hour_sin": F.sin(wave(hour, 24)), "hour_cos": F.cos(wave(hour, 24)), "dow_sin": F.sin(wave(dow, 7)), "dow_cos": F.cos(wave(dow, 7)),
        "month_sin": F.sin(wave(month, 12)), "month_cos": F.cos(wave(month, 12)),
        "is_weekend": (dow >= 5).cast("int"), "trading_hours": hour.between(9, 16).cast("int"),
        "session": F.when(hour < 8, "asia").when(hour < 16, "europe").otherwise("america"),
    }


def pivot_levels(high: Column, low: Column, close: Column) -> dict[str, Column]:
    p = (high + low + close) / 3
    return {
        "pivot": p, "r1": 2 * p - low, "s1": 2 * p - high, "r2": p + (high - low), "s2": p - (high - low),
        "r3": high + 2 * (p - low), "s3": low - 2 * (high - p),
    }


# Fibonacci retracement shares.
FIBONACCI = (0.236, 0.382, 0.5, 0.618)


def fibonacci_levels(high: Column, low: Column) -> dict[str, Column]:
    return {f"fib_{int(f * 1000)}": low + (high - low) * f for f in FIBONACCI}


def volume_features(o: WindowSpec, k: int = 20, spike: float = 2.0) -> dict[str, Column]:
    mean = sma("volume", o, k)
    return {"volume_sma": mean, "volume_ratio": ratio("volume", mean), "volume_spike": flag(c("volume") > spike * mean)}


def crossover(a: Column, b: Column, o: WindowSpec) -> Column:
    """Change of the sign of a - b against the row before, halved: 1 crosses up, -1 down."""
    s = F.signum(a - b)
    return (s - F.lag(s).over(o)) / 2


def momentum_columns(o: WindowSpec, k: int) -> dict[str, Column]:
    before = F.lag("close", k).over(o)
    return {f"momentum_{k}": c("close") - before, f"roc_{k}": 100 * (ratio("close", before) - 1)}
