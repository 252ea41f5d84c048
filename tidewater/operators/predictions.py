"""Prediction tracking, accuracy, drift, ensembles and backtest folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import c, clip, ratio, so_far
from ..functions.linear import dot, moments, solve


def due(df: DataFrame, now: Column, t: str = "t", hours: str = "horizon") -> DataFrame:
    """Predictions whose own horizon has passed."""
    return df.where(c(t) <= now - F.make_dt_interval(hours=c(hours).cast("int")))


def evaluate(df: DataFrame, current: str, predicted: str, actual: str, probability: str) -> DataFrame:
    """Direction and price accuracy, and a quality score of the two and the probability."""
    sign = lambda x: F.when(x > c(current), "UP").when(x < c(current), "DOWN").otherwise("FLAT")
    df = df.withColumn("predicted_direction", sign(c(predicted))).withColumn("actual_direction", sign(c(actual)))
    right = F.col("predicted_direction") == F.col("actual_direction")
    accuracy = clip(1 - F.abs(ratio(c(predicted) - c(actual), actual)), 0.0, 1.0)
    score = 0.5 * right.cast("double") + 0.3 * accuracy + 0.2 * F.when(right, c(probability) / 100).otherwise(1 - c(probability) / 100)
    return df.withColumn("direction_correct", right).withColumn("price_accuracy", accuracy).withColumn("quality", score)


def accuracy_by(df: DataFrame, by: list[str], right: str, probability: str, sure: float = 70.0) -> DataFrame:
    """Accuracy by group and the false positive share among sure predictions."""
    confident = c(probability) >= sure
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(c(right).cast("double")).alias("accuracy"), F.count_if(confident).alias("n_sure"),
        (F.count_if(confident & ~c(right)) / F.nullif(F.count_if(confident), F.lit(0))).alias("false_positive"),
    )


def probability_buckets(df: DataFrame, right: str, probability: str, width: int = 10) -> DataFrame:
    bucket = (F.floor(c(probability) / width) * width).cast("long")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(c(right).cast("double")).alias("accuracy"))


def threshold_sweep(df: DataFrame, right: str, probability: str, thresholds: list[int]) -> DataFrame:
    """Accuracy and coverage at each threshold; ``best`` marks the greatest product. One aggregate over the rows."""
    one = df.agg(F.count("*").alias("n"), *[x for t in thresholds for x in (F.count_if(c(probability) >= t).alias(f"n{t}"), F.avg(F.when(c(probability) >= t, c(right).cast("double"))).alias(f"a{t}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("covered"), F.col(f"a{t}").alias("accuracy")) for t in thresholds]))
    long = one.select("n", rows.alias("x")).select("x.threshold", "x.accuracy", (F.col("x.covered") / F.col("n")).alias("coverage"))
    long = long.withColumn("value", F.coalesce(F.col("accuracy") * F.col("coverage"), F.lit(0.0)))
    top = long.agg(F.max_by("threshold", F.struct("value", -F.col("threshold"))).alias("best"))
    best = top.collect()[0]["best"]  # one number
    return long.withColumn("best", F.col("threshold") == F.lit(best))


def error_drift(x: str, o: WindowSpec, k: int) -> Column:
    """Mean of the last k errors against the k before, as a relative change."""
    new, old = o.rowsBetween(-(k - 1), 0), o.rowsBetween(-(2 * k - 1), -k)
    return F.when(F.count(x).over(old) == k, ratio(F.avg(x).over(new), F.avg(x).over(old)) - 1)


def inverse_error_ensemble(df: DataFrame, by: list[str], predicted: str, error: str) -> DataFrame:
    """Mean of the members' predictions weighted by the inverse of their error."""
    w = 1 / (c(error) + 1e-6)
    return df.groupBy(*by).agg((F.sum(c(predicted) * w) / F.sum(w)).alias("ensemble"), F.count("*").alias("members"))


def weighted_vote(df: DataFrame, by: list[str], direction: str, weight: str) -> DataFrame:
    """The direction of greatest total weight; ties go to the first in the alphabet."""
    each = df.groupBy(*by, direction).agg(F.sum(weight).alias("__w"))
    top = each.groupBy(*by).agg(F.max("__w").alias("__m"), F.sum("__w").alias("__t"))
    return each.join(top, by).where(F.col("__w") == F.col("__m")).groupBy(*by).agg(F.min(direction).alias("vote"), F.first(F.col("__m") / F.nullif(F.col("__t"), F.lit(0.0))).alias("confidence"))


def folds(n_rows: int, train: int, test: int, step: int | None = None, gap: int = 0, expanding: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(fold, first and last training row, first and last test row), rows counted from 1."""
    out, start, i = [], 1, 0
    while start + train + gap + test - 1 <= n_rows:
        out.append((i, 1 if expanding else start, start + train - 1, start + train + gap, start + train + gap + test - 1))
        start, i = start + (step or test), i + 1
    return out


def walk_forward(df: DataFrame, o: WindowSpec, train: int, test: int, step: int | None = None, gap: int = 0, key: str = "k") -> DataFrame:
    """Rows with (fold, part) for each fold they are in, by row number within the key; as many folds as each key's rows hold.

    Fold f begins at row f * step, so a row's folds follow from its number: no plan is kept, and a row costs its own folds.
    """
    step, whole = step or test, train + gap + test
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    df = df.withColumn("__i", F.row_number().over(o) - 1).join(n, F.col(key) == F.col("__k"))
    first = F.greatest(F.ceil((F.col("__i") - (whole - 1)) / step), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("__i") / step), F.floor((F.col("__n") - whole) / step)).cast("long")
    df = df.where(last >= first).withColumn("fold", F.explode(F.sequence(first, last))).withColumn("__j", F.col("__i") - F.col("fold") * step)
    df = df.where((F.col("__j") < train) | (F.col("__j") >= train + gap)).withColumn("part", F.when(F.col("__j") < train, "train").otherwise("test"))
    return df.withColumn("fold", F.col("fold").cast("int")).drop("__i", "__j", "__k", "__n")


def sliding_windows(df: DataFrame, o: WindowSpec, size: int, step: int) -> DataFrame:
    """Rows with the number of each overlapping window they are in: window w holds rows w * step + 1 .. w * step + size."""
    df = df.withColumn("__i", F.row_number().over(o) - 1)
    first = F.greatest(F.ceil((F.col("__i") - (size - 1)) / step), F.lit(0))
    return df.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col("__i") / step).cast("long")))).drop("__i")


def purged_groups(df: DataFrame, o: WindowSpec, t: str, gap_hours: int, test_group: int, purge_hours: int, key: str = "k") -> DataFrame:
    """Groups of rows without gaps; rows near the test group are purged from training."""
    from ..functions.columns import islands

    before = F.lag(t).over(o)
    start = F.coalesce(F.unix_timestamp(t) - F.unix_timestamp(before) > gap_hours * 3600, F.lit(True))
    df = df.withColumn("__s", start).withColumn("group_id", islands(F.col("__s"), o)).drop("__s")
    ends = df.where(F.col("group_id") == test_group).groupBy(key).agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    near = (F.unix_timestamp(t) >= F.unix_timestamp("__a") - purge_hours * 3600) & (F.unix_timestamp(t) <= F.unix_timestamp("__b") + purge_hours * 3600)
    part = F.when(F.col("group_id") == test_group, "test").when(F.coalesce(near, F.lit(False)), "purged").otherwise("train")
    return df.join(ends, key, "left").withColumn("part", part).drop("__a", "__b")


def blocking(df: DataFrame, o: WindowSpec, splits: int, block: int | None = None, separation: int = 0, key: str = "k") -> DataFrame:
    """Rows with (fold, part): each key's rows fall into ``splits`` blocks with gaps; a fold tests on one block and trains on the others.

    Blocks take a third of a fold's share of the rows, 50 at least, or what the rows allow. Rows between blocks are in no fold.
    """
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    df = df.withColumn("__i", F.row_number().over(o) - 1).join(n, F.col(key) == F.col("__k"))
    wanted = F.lit(block) if block else F.greatest(F.lit(50), F.floor(F.col("__n") / (splits * 3)))
    gaps = (splits - 1) * separation
    size = F.when(splits * wanted + gaps > F.col("__n"), F.floor((F.col("__n") - gaps) / splits)).otherwise(wanted)
    df = df.withColumn("__z", size + separation).withColumn("__b", F.floor(F.col("__i") / F.col("__z")))
    df = df.where((F.col("__i") % F.col("__z") < F.col("__z") - separation) & (F.col("__b") < splits))
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return df.withColumn("part", F.when(F.col("__b") == F.col("fold"), "test").otherwise("train")).drop("__i", "__k", "__n", "__z", "__b")


def adaptive_folds(df: DataFrame, x: str, o: WindowSpec, least: int = 500, most: int = 2000, test: int = 48, step: int = 24, lookback: int = 168, bound: float = 0.05, key: str = "k") -> DataFrame:
    """(key, fold, volatility, train_start, train_stop, test_stop) in row numbers from 0, ends exclusive.

    A fold starts every ``step`` rows from ``least`` on, while a test part follows. Where the returns within the last
    ``lookback`` rows spread more than ``bound``, it trains on ``least`` rows and tests on half of ``test`` (12 at least),
    else on ``most`` and ``test``. Positions with under ten rows of history train on ``least``.
    """
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    i = F.row_number().over(o) - 1
    before = o.rowsBetween(-(lookback - 1), -1)
    df = df.withColumn("__r", F.when(i > 0, F.col(x) / F.nullif(F.lag(x).over(o), F.lit(0.0)) - 1))
    df = df.withColumn("__i", i).withColumn("volatility", F.when(F.col("__i") >= 10, F.stddev_samp("__r").over(before)))
    df = df.join(n, F.col(key) == F.col("__k")).where((F.col("__i") >= least) & ((F.col("__i") - least) % step == 0) & (F.col("__i") < F.col("__n") - test))
    wild = F.coalesce(F.col("volatility") > bound, F.lit(False))
    few = F.col("__i") < 10
    train = F.least(F.when(wild | few, least).otherwise(most), F.col("__i"))
    size = F.when(wild, max(12, test // 2)).otherwise(test)
    fold = ((F.col("__i") - least) / step).cast("int") + 1
    return df.select(key, fold.alias("fold"), "volatility", (F.col("__i") - train).alias("train_start"), F.col("__i").alias("train_stop"), F.least(F.col("__i") + size, F.col("__n")).alias("test_stop"))


def fitted_at(df: DataFrame, x: str, features: list[str], o: WindowSpec, horizon: int, ridge: float = 1.0, history: int = 168, every: int = 1, key: str = "k", t: str = "t") -> DataFrame:
    """(key, t, n, predicted, actual, ape, direction_correct): at each row a ridge regression of what was known then.

    The target is the change of x over the next ``horizon`` rows. At row s the pairs are those whose outcome has
    come by s, so their features lie ``horizon`` rows back at least: running sums of products hold the normal equations of
    every row, and each row solves its own small system, with no fit before it repeated and no later row seen. Rows with
    under ``history`` rows before them, or without an outcome yet, give none; ``every`` keeps each so-manieth row. Null
    features leave a pair out, and a row whose own features are null predicts null.
    """
    level = {f"__{j}": c(f).cast("double") for j, f in enumerate(features)}
    d = df.select(key, t, c(x).alias("__x"), F.row_number().over(o).alias("__i"), *[v.alias(n) for n, v in level.items()])
    names = list(level)
    past = {f"__p{n}": F.lag(n, horizon).over(o) for n in names}
    d = d.withColumns(past | {"__y": ratio("__x", F.lag("__x", horizon).over(o)) - 1, "actual": F.lead("__x", horizon).over(o)})
    known = F.col("__y").isNotNull()
    for n in past:
        known = known & F.col(n).isNotNull()
    columns = [F.when(known, v) for v in (F.lit(1.0), *map(F.col, past))]
    seen = so_far(o)
    xx, xy, _ = moments(columns, F.when(known, F.col("__y")), lambda v: F.sum(v).over(seen))
    d = d.withColumns({"__xx": xx, "__xy": xy, "n": F.count(F.when(known, 1)).over(seen)})
    d = d.where((F.col("__i") > history) & (F.col("__i") % every == 0) & (F.col("n") > len(names) + 1) & F.col("actual").isNotNull())
    b, _ = solve(F.col("__xx"), F.col("__xy"), ridge)
    d = d.withColumn("__b", b)
    change = dot(F.col("__b"), F.array(F.lit(1.0), *map(F.col, names)))
    d = d.withColumn("predicted", F.col("__x") * (1 + change))
    right = (F.col("predicted") > F.col("__x")) == (F.col("actual") > F.col("__x"))
    return d.select(key, t, "n", "predicted", "actual", ratio(F.abs(F.col("predicted") - F.col("actual")), "actual").alias("ape"), right.alias("direction_correct"))


def fold_scores(df: DataFrame, target: str, features: list[str], key: str = "k") -> DataFrame:
    """(key, fold, part, mae, rmse, r2, direction_accuracy) of a least-squares fit on each fold's training part.

    ``df`` has (fold, part) as ``walk_forward`` gives them. One aggregate fits all folds, one scores both parts. Rows with a
    null don't count; folds whose fit is singular score null.
    """
    d = df.dropna(subset=[target, *features])
    columns = [F.lit(1.0), *[c(f).cast("double") for f in features]]
    xx, xy, _ = moments(columns, c(target).cast("double"))
    sums = d.where("part = 'train'").groupBy(key, "fold").agg(xx.alias("__xx"), xy.alias("__xy"))
    b, _ = solve(F.col("__xx"), F.col("__xy"))
    fits = sums.select(key, "fold", b.alias("__b"))
    scored = d.join(fits, [key, "fold"]).withColumn("__p", dot(F.col("__b"), F.array(*columns)))
    y, e = c(target), c(target) - F.col("__p")
    right = (F.col("__p") > 0) == (y > 0)
    r2 = 1 - ratio(F.sum(e * e), F.var_pop(y) * F.count(y))
    return scored.groupBy(key, "fold", "part").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"), F.avg(right.cast("double")).alias("direction_accuracy"))


def fold_summary(scores: DataFrame, key: str = "k") -> DataFrame:
    """(key, metric, folds, train_mean, train_std, test_mean, test_std, overfitting): each metric over the folds.

    Deviations have ddof 0. Overfitting is what training has over testing where more is better (r2, direction), and
    the reverse for errors.
    """
    metrics = ["mae", "rmse", "r2", "direction_accuracy"]
    long = scores.unpivot([key, "fold", "part"], metrics, "metric", "value")
    of = lambda f, part: f(F.when(F.col("part") == part, F.col("value")))
    s = long.groupBy(key, "metric").agg(F.countDistinct("fold").alias("folds"), *[of(f, part).alias(f"{part}_{name}") for part in ("train", "test") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    gap = F.col("train_mean") - F.col("test_mean")
    return s.withColumn("overfitting", F.when(F.col("metric").isin("r2", "direction_accuracy"), gap).otherwise(-gap))


def indicator_prediction(df: DataFrame, rules: dict[str, tuple[float, float, float, float]], by: list[str]) -> DataFrame:
    """(by, change, timeframe, confidence, triggers) from indicators beyond their thresholds, weighted by confidence.

    ``df`` has (by, name, value); a rule is (threshold, correlation, price impact, lag in hours). An indicator beyond its
    threshold moves the price by correlation x impact x value / threshold, with a confidence of 100 |correlation|.
    Groups in which none is beyond give zeros and no triggers.
    """
    table = F.create_map(*[x for name, v in rules.items() for x in (F.lit(name), F.array(*map(F.lit, map(float, v))))])
    d = df.withColumn("__r", F.try_element_at(table, F.col("name")))
    threshold, correlation, impact, lag = (F.get("__r", F.lit(j)) for j in range(4))
    beyond = F.abs("value") > threshold
    weight = F.when(beyond, F.abs(correlation) * 100)
    change = correlation * impact * F.col("value") / threshold
    trigger = F.when(beyond, F.concat("name", F.lit("="), F.format_string("%.2f", F.col("value").cast("double"))))
    s = d.groupBy(*by).agg(F.sum(weight).alias("__w"), F.sum(change * weight).alias("__c"), F.sum(lag * weight).alias("__l"), F.count(weight).alias("__n"), F.array_sort(F.collect_list(trigger)).alias("triggers"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return s.select(*by, zero(ratio("__c", "__w")).alias("change"), F.floor(zero(ratio("__l", "__w"))).cast("int").alias("timeframe"), F.least(zero(ratio("__w", F.col("__n").cast("double"))), F.lit(100.0)).alias("confidence"), "triggers")


def confidence_ensemble(df: DataFrame, weights: dict[str, float], by: list[str]) -> DataFrame:
    """(by, predicted_change, timeframe_hours, confidence) of methods' predictions, each weighing its weight times its confidence.

    ``df`` has (by, method, change, timeframe, confidence); methods without confidence or weight don't count; where none does,
    the change is 0 over 6 hours without confidence.
    """
    table = F.create_map(*[x for name, v in weights.items() for x in (F.lit(name), F.lit(float(v)))])
    w = F.when(F.col("confidence") > 0, F.try_element_at(table, F.col("method")) * F.col("confidence") / 100)
    s = df.groupBy(*by).agg(F.sum(w).alias("__w"), *[F.sum(F.col(n) * w).alias(f"__{n}") for n in ("change", "timeframe", "confidence")])
    part = lambda n, other: F.coalesce(ratio(f"__{n}", "__w"), F.lit(other))
    return s.select(*by, part("change", 0.0).alias("predicted_change"), F.floor(part("timeframe", 6.0)).cast("int").alias("timeframe_hours"), part("confidence", 0.0).alias("confidence"))


def drift(df: DataFrame, columns: list[str], o: WindowSpec, window: int = 50, bound: float = 0.1) -> DataFrame:
    """Adds, for each column, the absolute difference of the means of the window's halves, their mean and whether it exceeds ``bound``.

    Null (and no drift) before the window is full.
    """
    half = window // 2
    new, old = o.rowsBetween(-(half - 1), 0), o.rowsBetween(-(window - 1), -(window - half))
    full = F.count(F.lit(1)).over(o.rowsBetween(-(window - 1), 0)) == window
    parts = {f"{x}_drift": F.when(full, F.abs(F.avg(x).over(new) - F.avg(x).over(old))) for x in columns}
    df = df.withColumns(parts)
    df = df.withColumn("combined_drift", sum(F.col(n) for n in parts) / len(parts))
    return df.withColumn("drifted", F.coalesce(F.col("combined_drift") > bound, F.lit(False)))


def holdout(df: DataFrame, o: WindowSpec, train: float = 0.6, validation: float = 0.2, key: str = "k") -> DataFrame:
    """Adds ``part``: each key's rows in order, cut after int(n train) and int(n (train + validation)) of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    i = F.row_number().over(o)
    return df.withColumn("part", F.when(i <= F.floor(n * train), "train").when(i <= F.floor(n * (train + validation)), "validation").otherwise("test"))
