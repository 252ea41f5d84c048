"""Feature sets of sentiment, on-chain and macro series: windows over each key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, change, flag, full, pct_change, rolling, rows, sma


def known(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0; an unknown condition counts as false."""
    return flag(F.coalesce(condition, F.lit(False)))


def sentiment(df: DataFrame, x: str, o: WindowSpec, volume: str | None = None, news: str | None = None, key: str = "k") -> DataFrame:
    """Adds means, momentum, spread, extremes beyond the key's own tenth and ninetieth percentile, and changes of ``x``.

    With ``volume`` also its spikes and product, with ``news`` the divergence from it. The percentiles hold a key's
    distinct values in one task: give it bars, not raw events.
    """
    ends = df.groupBy(F.col(key).alias("__k")).agg(F.percentile(x, F.lit(0.9)).alias("__hi"), F.percentile(x, F.lit(0.1)).alias("__lo"))
    mean = sma(x, o, 7)
    found = df.join(ends, F.col(key) == F.col("__k"), "left").withColumns({
        "sma_3": sma(x, o, 3), "sma_7": mean, "momentum": c(x) - mean, "volatility": rolling("std", x, o, 7),
        "bullish": known(c(x) > F.col("__hi")), "bearish": known(c(x) < F.col("__lo")),
        "change_1": pct_change(x, o), "change_3": pct_change(x, o, 3),
    })
    if volume:
        found = found.withColumns({"volume_spike": known(c(volume) > 2 * sma(volume, o, 7)), "volume_product": c(x) * c(volume)})
    if news:
        found = found.withColumn("divergence", c(x) - c(news))
    return found.drop("__k", "__hi", "__lo")


def on_chain(df: DataFrame, whales: str, flows: str, health: str, dormancy: str, addresses: str, o: WindowSpec) -> DataFrame:
    """Adds whale means and spikes, flow trend and accumulation, and changes of health, dormancy and addresses."""
    high = sma(whales, o, 30) + 2 * rolling("std", whales, o, 30)
    return df.withColumns({
        "whale_ma7": sma(whales, o, 7), "whale_spike": known(c(whales) > high), "flow_trend": c(flows) - sma(flows, o, 7),
        "accumulation": known(c(flows) < -0.1), "health_change": pct_change(health, o), "coin_aging": sma(dormancy, o, 30), "growth_7": pct_change(addresses, o, 7),
    })


def macro(df: DataFrame, rates: str, dollar: str, equity: str, score: str, o: WindowSpec) -> DataFrame:
    """Adds trend and acceleration of rates, dollar momentum, risk on (1) or off (-1), and jumps of the overall score."""
    frame = rows(o, 3)
    df = df.withColumn("__d", change(rates, o))
    return df.withColumns({
        "rates_trend": sma(rates, o, 7), "rates_acceleration": full(F.avg("__d").over(frame), "__d", frame, 3), "dollar_momentum": c(dollar) - sma(dollar, o, 14),
        "risk_on_off": F.when(c(equity) > 0.1, 1).when(c(equity) < -0.1, -1).otherwise(0), "regime_change": known(F.abs(change(score, o)) > 0.2),
    }).drop("__d")


def stress(level: Column, credit: Column, currency: Column) -> Column:
    """Market stress: .5 of the volatility level from 15 (calm) to 45, .3 of credit and .2 of currency stress; 0.3 stands for an unknown level."""
    level = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (level - 15) / 30)), F.lit(0.3))
    return level * 0.5 + credit * 0.3 + currency * 0.2


def bias(score: Column, bound: float) -> Column:
    """BULLISH above the bound, BEARISH below its negative, else (unknown scores too) NEUTRAL."""
    return F.when(score > bound, "BULLISH").when(score < -bound, "BEARISH").otherwise("NEUTRAL")


def correlation_regime(strong: Column) -> Column:
    """By the number of strong correlations."""
    return F.when(strong >= 3, "HIGH_CORRELATION").when(strong <= 1, "LOW_CORRELATION").otherwise("NORMAL")


def interactions(rsi: str = "rsi", band: str = "bb_position", mood: str = "sentiment", whale: str = "whale", momentum: str = "momentum", macro: str = "macro", atr: str = "atr") -> dict[str, Column]:
    """Named interactions of technical, mood, on-chain and macro columns."""
    return {
        "rsi_bb_combo": c(rsi) * c(band), "oversold_squeeze": known((c(rsi) < 30) & (c(band) < 0.2)), "sentiment_rsi_divergence": c(mood) - c(rsi) / 100,
        "whale_momentum_sync": c(whale) * F.signum(c(momentum)), "macro_volatility_interaction": c(macro) * c(atr),
    }
