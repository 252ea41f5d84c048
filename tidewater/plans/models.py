"""Kernels and models, checked by rows and by tests rather than by SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import log_return, pct_change, rolling, sma
from ..operators import ewm, kernels
from ..sources import tables as tb
from ..sources.tables import by_time
from .registry import query


def features(spark: SparkSession, d: str) -> DataFrame:
    """Returns, their volatility and momentum, with the next return as target."""
    df = tb.hourly(spark, d).withColumn("r", log_return("close", by_time()))
    return df.select(
        "k", "t", "r", rolling("std", "r", by_time(), 24).alias("vol"), sma("r", by_time(), 6).alias("momentum"), F.lag("r").over(by_time()).alias("lag_1"), F.lead("r").over(by_time()).alias("target"),
    ).dropna()


_X = ["r", "vol", "momentum", "lag_1"]


@query("kmeans_regimes")
def kmeans_regimes(spark: SparkSession, d: str) -> DataFrame:
    df = VectorAssembler(inputCols=["vol", "momentum"], outputCol="x").transform(features(spark, d))
    model = KMeans(k=3, seed=42, featuresCol="x", predictionCol="regime").fit(df)
    return model.transform(df).select("k", "t", "regime")


@query("rf_importance")
def rf_importance(spark: SparkSession, d: str) -> DataFrame:
    df = VectorAssembler(inputCols=_X, outputCol="x").transform(features(spark, d))
    model = RandomForestRegressor(featuresCol="x", labelCol="target", numTrees=20, maxDepth=5, seed=42).fit(df)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(_X, model.featureImportances.toArray())], "feature string, importance double")


@query("ensemble_predictions")
def ensemble_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a forest, boosted trees and a ridge regression trained on the first 80 % of the hours."""
    df = VectorAssembler(inputCols=_X, outputCol="x").transform(features(spark, d))
    cut = df.select(F.expr("percentile_approx(unix_timestamp(t), 0.8)")).collect()[0][0]
    train, test = df.where(F.unix_timestamp("t") <= cut), df.where(F.unix_timestamp("t") > cut)
    members = [
        RandomForestRegressor(featuresCol="x", labelCol="target", numTrees=20, seed=42, predictionCol="p0"), GBTRegressor(featuresCol="x", labelCol="target", maxIter=10, seed=42, predictionCol="p1"),
        LinearRegression(featuresCol="x", labelCol="target", regParam=0.1, elasticNetParam=0.0, predictionCol="p2"),
    ]
    found = Pipeline(stages=members).fit(train).transform(test)
    return found.select("k", "t", "target", ((F.col("p0") + F.col("p1") + F.col("p2")) / 3).alias("predicted"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    return tb.hourly(spark, d).select("k", "t", pct_change("close", by_time()).alias("r"), "close")


@query("fft_cycles")
def fft_cycles(spark: SparkSession, d: str) -> DataFrame:
    return kernels.per_key(_series(spark, d), "k", "t", "close", kernels.fft_cycles, "rank int, period double, share double")


@query("entropy_suite")
def entropy_suite(spark: SparkSession, d: str) -> DataFrame:
    schema = "n long, sample_entropy double, hurst double, lempel_ziv double, dfa double, centroid double, rolloff double, zlib_ratio double"
    return kernels.per_key(_series(spark, d), "k", "t", "close", kernels.entropy_suite, schema)


@query("denoise")
def denoise(spark: SparkSession, d: str) -> DataFrame:
    return kernels.per_key(_series(spark, d), "k", "t", "close", kernels.denoised, "t timestamp, savgol double, median_gauss double, trend double, haar double, wiener double", timed=True)


@query("hmm_states")
def hmm_states(spark: SparkSession, d: str) -> DataFrame:
    df = tb.hourly(spark, d).withColumn("r", log_return("close", by_time()))
    return kernels.per_key(df, "k", "t", "r", kernels.hidden_markov, "t timestamp, state int, p double", timed=True)


@query("iforest")
def iforest(spark: SparkSession, d: str) -> DataFrame:
    return kernels.per_key(_series(spark, d), "k", "t", "close", kernels.isolation_scores, "t timestamp, score double, outlier boolean", timed=True)


@query("spaced_peaks")
def spaced_peaks(spark: SparkSession, d: str) -> DataFrame:
    return kernels.per_key(_series(spark, d), "k", "t", "close", kernels.spaced_peaks, "t timestamp, value double", timed=True)


@query("support_resistance")
def support_resistance(spark: SparkSession, d: str) -> DataFrame:
    schema = "t timestamp, kind string, level double, strength int, distance_pct double, nearest boolean"
    return kernels.per_key(_series(spark, d), "k", "t", "close", kernels.support_resistance, schema, timed=True)


@query("kalman_level")
def kalman_level(spark: SparkSession, d: str) -> DataFrame:
    return ewm.kalman_level(tb.hourly(spark, d).select("k", "t", "close"), "close", "level")


@query("mc_paths")
def mc_paths(spark: SparkSession, d: str) -> DataFrame:
    stats = tb.daily(spark, d).select("k", (pct_change("close", by_time()) / 100).alias("r")).groupBy("k").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    paths = kernels.simulated_paths(stats, "k", "m", "s")
    last = paths.where("step = 168").groupBy("k")
    return last.agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.05)).alias("p05"), F.percentile("value", F.lit(0.95)).alias("p95"))
