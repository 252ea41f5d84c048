"""Lexicon sentiment, keywords and JSON indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, clip, ratio

# Lexicon terms and their weights.
POSITIVE = {"moon": 3, "bullish": 3, "buy": 2, "pump": 2, "gain": 1, "rise": 1, "good": 1}
NEGATIVE = {"crash": 3, "bearish": 3, "sell": 2, "dump": 2, "loss": 1, "fall": 1, "bad": 1}
KEYWORDS = ("bitcoin", "btc", "crypto", "halving", "etf", "whale", "mining", "wallet", "exchange", "regulation", "the", "of", "and")


def lexicon_score(text: Column | str, positive: dict[str, int] | None = None, negative: dict[str, int] | None = None) -> Column:
    """(positive - negative) / (positive + negative) of weighted whole-word counts, in [-1, 1]; 0 without hits."""
    words_ = F.split(F.lower(c(text)), r"[^\p{L}]+")
    weight = lambda words, w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in words.items() for v in pair]), w), F.lit(0))
    total = lambda words: F.aggregate(words_, F.lit(0), lambda a, w: a + weight(words, w))
    p, n = total(POSITIVE if positive is None else positive), total(NEGATIVE if negative is None else negative)
    return F.coalesce(clip(ratio((p - n).cast("double"), (p + n).cast("double")), -1.0, 1.0), F.lit(0.0))


def keywords(text: Column | str, words: tuple[str, ...] = KEYWORDS, most: int = 10) -> Column:
    """The first ``most`` words of a fixed list that the text contains."""
    low = F.lower(c(text))
    return F.slice(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in words])), 1, most)


def keyword_topk(df: DataFrame, text: str, k: int = 10) -> DataFrame:
    each = df.select(F.explode(keywords(text)).alias("keyword"))
    return each.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def json_number(json: Column | str, paths: list[str]) -> Column:
    """The first of the dotted paths that holds a number."""
    return F.coalesce(*[F.get_json_object(c(json), "$." + p).try_cast("double") for p in paths])


def flatten_numbers(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """(keep..., path, value): every numeric leaf of JSON documents of any shape, two levels deep by map, natively."""
    top = df.select(*keep, F.explode(F.from_json(json, "map<string,string>")).alias("__k", "__v"))
    inner = F.coalesce(F.from_json("__v", "map<string,string>"), F.create_map().cast("map<string,string>"))
    nested = top.where(F.col("__v").startswith("{")).select(*keep, "__k", F.explode(inner).alias("__k2", "__v2")).select(*keep, F.concat_ws(".", "__k", "__k2").alias("path"), F.col("__v2").try_cast("double").alias("value"))
    flat = top.where(~F.col("__v").startswith("{")).select(*keep, F.col("__k").alias("path"), F.col("__v").try_cast("double").alias("value"))
    return flat.unionByName(nested).where("value IS NOT NULL")


def matching(df: DataFrame, contains: dict[str, str | None] | None = None, equals: dict[str, object] | None = None, since: tuple[str, object] | None = None, limit: int | None = None) -> DataFrame:
    """The rows for which all given conditions hold: columns that contain a text (without regard to case), columns that equal
    a value, a column from a value on. None leaves a condition out; ``limit`` keeps a command log's first rows."""
    for name, part in (contains or {}).items():
        if part is not None:
            df = df.where(F.contains(F.lower(name), F.lit(part.lower())))
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    if since is not None:
        df = df.where(F.col(since[0]) >= F.lit(since[1]))
    return df if limit is None else df.limit(limit)
