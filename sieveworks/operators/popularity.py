"""Popularity: token statistics, roll-ups over bridges, smoothing, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_popularity(post: DataFrame, weights: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(term, mean_pop, min_pop) over the documents that hold the term; tokens (term) restrict before aggregating."""
    p = post.select("term", "id")
    if tokens is not None:
        p = p.join(tokens.select("term").distinct(), "term", "left_semi")
    return p.join(weights.select("id", F.col("pop").cast("double").alias("pop")), "id").groupBy("term").agg(F.avg("pop").alias("mean_pop"), F.min("pop").alias("min_pop"))


def rollup(entities: DataFrame, bridge: DataFrame, left: str, right: str, weight: str) -> DataFrame:
    """(right, popularity): the weights of linked entities summed through a bridge."""
    return bridge.join(entities.select(left, weight), left).groupBy(right).agg(F.sum(weight).alias("popularity"))


def laplace(weights: DataFrame, alpha: float, weight: str = "pop") -> DataFrame:
    """weights with ``smoothed`` = (w + alpha) / (N + V alpha), N their sum and V their number; absent weights count 0."""
    s = weights.agg(F.sum(F.coalesce(weight, F.lit(0))).alias("_n"), F.count("*").alias("_v"))
    return weights.crossJoin(F.broadcast(s)).withColumn("smoothed", (F.coalesce(F.col(weight), F.lit(0)) + alpha) / (F.col("_n") + F.col("_v") * alpha)).drop("_n", "_v")


def flatten(queries: DataFrame, frequency: str = "freq") -> DataFrame:
    """Each query repeated frequency times with instance 0..frequency - 1."""
    return queries.where(F.col(frequency) > 0).withColumn("instance", F.explode(F.sequence(F.lit(0), F.col(frequency).cast("int") - 1)))


def fill_missing(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def moments(run: DataFrame, popularity: DataFrame, k: int = 20) -> DataFrame:
    """(qid, mean, var) of the first k results' popularity, divided by k."""
    p = F.col("pop").cast("double")
    j = run.where(F.col("rank") <= k).join(popularity.select("id", "pop"), "id").groupBy("qid").agg((F.sum(p) / k).alias("m"), (F.sum(p * p) / k).alias("m2"))
    return j.select("qid", F.round("m", 6).alias("mean"), F.round(F.col("m2") - F.col("m") * F.col("m"), 6).alias("var"))


def top_hits(scores: DataFrame, weights: DataFrame, k: int = 10000) -> DataFrame:
    """(qid, mean_mean, mean_min, min_mean, min_min) of each query term's mean and smallest weight over its k best hits; the cut is the measure's."""
    place = F.row_number().over(Window.partitionBy("qid", "term").orderBy(F.round("score", 6).desc(), "id"))
    hits = scores.withColumn("_place", place).where(F.col("_place") <= k).join(weights.select("id", F.col("pop").cast("double").alias("pop")), "id")
    per = hits.groupBy("qid", "term").agg(F.sum("pop").alias("s"), F.count("*").alias("n"), F.min("pop").alias("low"))
    mean, r = F.col("s") / F.col("n"), lambda x: F.round(x, 6)
    return per.groupBy("qid").agg(r(F.avg(mean)).alias("mean_mean"), r(F.avg("low")).alias("mean_min"), r(F.min(mean)).alias("min_mean"), r(F.min("low")).alias("min_min"))
