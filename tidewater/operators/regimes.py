"""Market regimes by rule, and scores put together from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, change, pct_change, ratio, rolling, rows, sma

#: The bars' change a trend of N bars spans: from the first to the last of N rows.
TRENDS = (24, 72, 168)


def trend_pct(x: str, o: WindowSpec, k: int) -> Column:
    """Change in percent from the first to the last of k rows."""
    return 100 * (c(x) / F.lag(x, k - 1).over(o) - 1)


def seven_way(df: DataFrame, o: WindowSpec, x: str = "close") -> DataFrame:
    """Adds long, medium, short (trends), vol and the regime by trend first, then volatility; null in the first week."""
    short, medium, long_ = (trend_pct(x, o, k) for k in TRENDS)
    df = df.withColumn("__r", pct_change(x, o)).withColumns({"short": short, "medium": medium, "long": long_})
    df = df.withColumn("vol", F.when(F.col("long").isNotNull(), 100 * F.stddev_samp("__r").over(rows(o, 168)))).drop("__r")
    a, b, v = F.col("long"), F.col("medium"), F.col("vol")
    # fixed values: the rule's thresholds
    regime = (
        F.when(a.isNull(), None).when((a > 5) & (b > 2) & (v < 4), "strong_bull").when((a > 2) & (b > 0), "bull_market")
        .when((a < -5) & (b < -2) & (v < 4), "strong_bear").when((a < -2) & (b < 0), "bear_market")
        .when(v > 6, "high_volatility").when((F.abs(a) < 2) & (v < 3), "sideways").otherwise("transitional")
    )
    return df.withColumn("regime", regime)


def eight_way(df: DataFrame, o: WindowSpec, x: str = "close", k: int = 20) -> DataFrame:
    """Adds the regime by mean return and annualised volatility of k rows: crisis, recovery, or trend with volatility."""
    df = df.withColumn("__r", pct_change(x, o))
    df = df.withColumns({"mean": sma("__r", o, k), "vol": rolling("std", "__r", o, k) * F.sqrt(F.lit(252.0)), "momentum": rolling("sum", "__r", o, k)}).drop("__r")
    m, v = F.col("mean"), F.col("vol")
    trend = F.when(m > 0.15, "bull").when(m < -0.15, "bear").otherwise("sideways")
    named = F.concat(trend, F.when(v > 0.6, "_high_vol").otherwise("_low_vol"))
    regime = F.when(m.isNull() | v.isNull(), "sideways_low_vol").when(m < -0.2, "crisis").when((m > 0.1) & (F.coalesce("momentum", F.lit(0.0)) > 0.05), "recovery").otherwise(named)
    return df.withColumn("regime", regime)


def six_way(df: DataFrame, o: WindowSpec, x: str = "close", k: int = 60, steep: float = 0.1, key: str = "k") -> DataFrame:
    """Adds trend (slope of k rows over their mean), vol (of returns, times the root of 365) and the regime against the key's median vol.

    ``steep`` is the trend from which a market is no longer sideways.
    """
    df = df.withColumn("__r", pct_change(x, o)).withColumn("__i", F.row_number().over(o).cast("double"))
    frame = rows(o, k)
    slope = F.covar_samp("__i", x).over(frame) / F.var_samp("__i").over(frame)
    whole = F.count(x).over(frame) == k
    df = df.withColumn("trend", F.when(whole, slope / F.avg(x).over(frame))).withColumn("vol", rolling("std", "__r", o, k) * F.sqrt(F.lit(365.0)))
    middle = df.groupBy(F.col(key).alias("__k")).agg(F.median("vol").alias("__m"))
    df = df.join(middle, F.col(key) == F.col("__k"), "left").drop("__k")
    t, v, m = F.col("trend"), F.col("vol"), F.col("__m")
    side = F.when(v < m, "sideways_low_vol").otherwise("sideways_high_vol")
    named = F.concat(F.when(t > steep, "bull").otherwise("bear"), F.when(v < 1.2 * m, "_low_vol").otherwise("_high_vol"))
    regime = F.when(t.isNull() | v.isNull(), None).when(F.abs(t) > steep, named).otherwise(side)
    return df.withColumn("regime", regime).drop("__r", "__i", "__m")


def three_way(df: DataFrame, o: WindowSpec, x: str = "close", k: int = 24, bound: float = 0.01) -> DataFrame:
    """Adds bull_market, bear_market or sideways by the change over k rows; sideways where it isn't known."""
    trend = change(x, o, k) / F.lag(x, k).over(o)
    return df.withColumn("regime", F.when(trend > bound, "bull_market").when(trend < -bound, "bear_market").otherwise("sideways"))


def vote(scores: dict[str, Column]) -> tuple[Column, Column]:
    """The name of the highest score and that score; ties go to the first named."""
    best = F.greatest(*scores.values())
    name = F.lit(None).cast("string")
    for n, s in reversed(scores.items()):
        name = F.when(s == best, n).otherwise(name)
    return name, best


def regime_scores(trend: Column, strength: Column, volatility: Column, volume: Column) -> dict[str, Column]:
    """Scores of four regimes; ``volatility`` and ``volume`` are ratios to their averages."""

    def part(condition: Column, points: float | Column) -> Column:
        return F.when(condition, points).otherwise(0.0)

    slope = 0.4 * F.least(strength, F.lit(1.0))
    return {
        "bull": part(trend > 0, slope) + part(volume > 1.2, 0.3) + part(volatility < 1.2, 0.3),
        "bear": part(trend < 0, slope) + part(volume > 1.1, 0.3) + part(volatility > 0.8, 0.3),
        "sideways": part(strength < 0.3, 0.5) + part(volatility < 1.5, 0.3) + part((volume > 0.8) & (volume < 1.2), 0.2),
        "volatile": part(volatility > 2.0, 0.6) + part(volume > 1.5, 0.4),
    }


def weighted_score(parts: dict[str, float]) -> Column:
    """Sum of columns by weight; a missing part counts nothing."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + weight * F.coalesce(c(name), F.lit(0.0))
    return total


def pattern_similarity(current: dict[str, Column], pattern: dict[str, Column]) -> Column:
    """Mean of 1 - relative difference (0 at least) over the features both have; patterns of 0 don't count."""
    each = [F.when(pattern[n] != 0, F.greatest(F.lit(0.0), 1 - F.abs(current[n] - pattern[n]) / F.abs(pattern[n]))) for n in current if n in pattern]
    known = F.filter(F.array(*each), lambda v: v.isNotNull())
    return F.coalesce(ratio(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known)), F.lit(0.0))


#: The weights of the parts of the risk, and the levels' bounds.
RISK_WEIGHTS = {"sudden": 0.30, "pattern": 0.25, "anomaly": 0.20, "trend": 0.15, "correlation": 0.10}
RISK_LEVELS = (("CRITICAL", 0.8), ("WARNING", 0.6), ("INFO", 0.4))


def composite_risk(df: DataFrame, x: str, volume: str, other: str, o: WindowSpec, falls: dict[str, tuple[str, float, float]], key: str = "k", t: str = "t", history: int = 30) -> DataFrame:
    """(key, t, sudden, pattern, anomaly, trend, correlation, score, level), each part 0 to 1, beyond ``history`` rows.

    sudden: the move over five rows (full at 5 %), volume over the mean of the 30 rows before (full at fivefold; under it
    the part is negative) and a jump of ``other`` beyond 3 (full at 10), by 0.4, 0.25 and 0.15. pattern: likeness to the
    nearest of ``falls`` (which change, "day" or "week", its size, its severity) times its severity. anomaly: the return's
    distance from the mean of 50 rows in deviations (full at 6). trend: means of 5 and 10 rows against that of 20, and 100
    times the mean absolute acceleration of log prices (full at 0.1). correlation: of log returns with the changes of
    ``other``, the last ten rows against all before (full at a change of 0.5). What can't be worked out counts 0.
    """
    lag = lambda v, n=1: F.lag(v, n).over(o)
    move = lambda n: ratio(x, lag(x, n)) - 1
    frame = lambda k: o.rowsBetween(-(k - 1), 0)
    capped = lambda v: F.least(F.coalesce(v, F.lit(0.0)), F.lit(1.0))
    nz = lambda v: F.nullif(c(v), F.lit(0.0))
    d = df.withColumns({"__r": move(1), "__lr": F.ln(nz(x) / nz(lag(x))), "__od": c(other) - lag(other), "__five": move(5), "day": move(24), "week": move(168), "__i": F.row_number().over(o)})
    d = d.withColumn("__acc", F.col("__lr") - lag("__lr"))
    both = F.col("__lr").isNotNull() & F.col("__od").isNotNull()

    def correlation_over(w: WindowSpec) -> Column:
        a, b = F.when(both, F.col("__lr")), F.when(both, F.col("__od"))
        return ratio(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))

    d = d.withColumns({"__v": F.avg(volume).over(o.rowsBetween(-30, -1)), **{f"__m{k}": F.avg(x).over(frame(k)) for k in (5, 10, 20)}, "__a5": F.avg(F.abs("__acc")).over(frame(5)), "__mr": F.avg("__r").over(frame(50)), "__sr": F.stddev_samp("__r").over(frame(50)), "__cn": correlation_over(frame(10)), "__co": correlation_over(o.rowsBetween(Window.unboundedPreceding, -10))})
    jump = F.abs("__od")
    sudden = 0.4 * capped(F.abs("__five") / 0.05) + 0.25 * capped((ratio(volume, "__v") - 1) / 4) + 0.15 * F.when(jump > 3, capped(jump / 10)).otherwise(0.0)
    near = [F.struct(F.greatest(F.lit(0.0), 1 - F.abs(F.col(part) - value) / abs(value)).alias("like"), F.lit(-i).alias("i"), F.lit(severity).alias("severity")) for i, (part, value, severity) in enumerate(falls.values())]
    best = F.array_max(F.filter(F.array(*near), lambda s: s["like"].isNotNull()))
    trend = F.abs(ratio("__m5", "__m20") - 1) + F.abs(ratio("__m10", "__m20") - 1) + 100 * F.col("__a5")
    parts = {"sudden": sudden, "pattern": F.coalesce(best["like"] * best["severity"], F.lit(0.0)), "anomaly": capped(F.abs(ratio(F.col("__r") - F.col("__mr"), "__sr")) / 6), "trend": capped(trend / 0.1), "correlation": capped(F.abs(F.col("__cn") - F.col("__co")) / 0.5)}
    d = d.where(F.col("__i") > history).withColumns(parts)
    d = d.select(key, t, *parts, weighted_score(RISK_WEIGHTS).alias("score"))
    level = F
    for name, bound in RISK_LEVELS:
        level = level.when(F.round("score", 9) >= bound, name)
    return d.withColumn("level", level.otherwise("LOW"))


#: The upper bounds of the volatility classes.
VOLATILITY_CLASSES = ((0.02, "very_low"), (0.05, "low"), (0.10, "medium"), (0.20, "high"))


def volatility_class(v: Column | str) -> Column:
    out = F.when(c(v).isNull(), None)
    for bound, name in VOLATILITY_CLASSES:
        out = out.when(c(v) < bound, name)
    return out.otherwise("extreme")


def volatility_persistence(df: DataFrame, r: str, o: WindowSpec, k: int = 5, least: int = 20, key: str = "k") -> DataFrame:
    """(key, volatility, class, persistence): the deviation (ddof 0) of a key's returns with its class, and the first
    autocorrelation of its deviations over ``k`` rows, moved to 0..1; 0.5 under ``least`` returns or without spread."""
    d = df.where(c(r).isNotNull()).select(key, c(r).alias("__r"), rolling("std0", r, o, k).alias("__v"), F.row_number().over(o).alias("__i"))
    d = d.withColumn("__l", F.lag("__v").over(Window.partitionBy(key).orderBy("__i")))
    both = F.col("__v").isNotNull() & F.col("__l").isNotNull()
    a, b = F.when(both, F.col("__v")), F.when(both, F.col("__l"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    rho = F.when(spread > 1e-24, F.covar_pop(a, b) / spread)  # beneath are equal numbers with rounding
    s = d.groupBy(key).agg(F.stddev_pop("__r").alias("volatility"), F.count("*").alias("__n"), rho.alias("__c"))
    held = F.when((F.col("__n") < least) | F.col("__c").isNull(), 0.5).otherwise(F.least(F.greatest((F.col("__c") + 1) / 2, F.lit(0.0)), F.lit(1.0)))
    return s.select(key, "volatility", volatility_class("volatility").alias("class"), held.alias("persistence"))
