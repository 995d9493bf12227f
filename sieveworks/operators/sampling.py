"""Popularity-weighted sampling, splits and folds; everything is a deterministic function of a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unit(*cols):
    """A uniform number in [0, 1) from 52 bits of a hash that other SQL engines have too."""
    text = F.concat_ws("|", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def without_replacement(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 1) -> DataFrame:
    """(id, sampled): n of the weight's instances, each as likely, drawn without replacement (all, if fewer)."""
    inst = df.where(F.col(weight) > 0).select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))).alias("i"))
    u = _unit(F.lit(str(seed)), F.col("id").cast("string"), F.col("i").cast("string"))
    return inst.withColumn("u", u).orderBy("u", "id", "i").limit(n).groupBy("id").agg(F.count("*").alias("sampled"))


def with_replacement(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 1) -> DataFrame:
    """(id, sampled): n draws in proportion to weight, by inverse of the cumulative distribution.

    Every draw finds its row with one range join on cells of the distribution's range, not by comparing with all rows.
    """
    w = df.where(F.col(weight) > 0).select(F.col(id_col).alias("id"), F.col(weight).cast("double").alias("w"))
    total = w.agg(F.sum("w").alias("t"))
    # two levels: sums per slice of ids, then inside the slice
    sliced = w.withColumn("slice", F.pmod(F.hash("id"), F.lit(64)))
    before = sliced.groupBy("slice").agg(F.sum("w").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("slice", "base")
    inside = F.sum("w").over(Window.partitionBy("slice").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    cdf = sliced.withColumn("c", inside).join(F.broadcast(before), "slice").select("id", (F.col("base") + F.col("c") - F.col("w")).alias("lo"), (F.col("base") + F.col("c")).alias("hi"))
    cell = total.select((F.col("t") / 1024).alias("cell"))
    draws = df.sparkSession.range(n).select(_unit(F.lit(str(seed)), F.col("id").cast("string")).alias("u")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(cell))
    draws = draws.select((F.col("u") * F.col("t")).alias("x"), "cell").withColumn("k", F.floor(F.col("x") / F.col("cell")))
    spans = cdf.crossJoin(F.broadcast(cell)).withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / F.col("cell")), F.floor(F.col("hi") / F.col("cell")))))
    return draws.join(spans.drop("cell"), "k").where("x >= lo AND x < hi").groupBy("id").agg(F.count("*").alias("sampled"))


def train_test(df: DataFrame, sampled: DataFrame, id_col: str, weight: str) -> DataFrame:
    """(id, train, test): sampled counts and what is left of the weight."""
    j = df.select(F.col(id_col).alias("id"), F.col(weight).alias("w")).join(sampled, "id", "left").withColumn("train", F.coalesce("sampled", F.lit(0)))
    return j.select("id", "train", F.greatest(F.col("w") - F.col("train"), F.lit(0)).alias("test"))


def folds(df: DataFrame, id_col: str, stratum: str, k: int, seed: int = 1) -> DataFrame:
    """df with ``fold`` 0..k - 1, even within each stratum: positions by hash, modulo k."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def split(df: DataFrame, id_col: str, share: float, seed: int = 1) -> DataFrame:
    """df with ``train``: true for about ``share`` of the rows."""
    return df.withColumn("train", _unit(F.lit(str(seed)), id_col) < share)


def shuffled(df: DataFrame, id_col: str, n: int, seed: int = 1) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def modulo(df: DataFrame, id_col: str, n: int, part: int) -> DataFrame:
    return df.where(F.col(id_col) % n < part)


def pick_word(df: DataFrame, id_col: str, words: list[str], seed: int = 1) -> DataFrame:
    """df with ``keyword``: a word of the list for each row, each as likely."""
    at = F.floor(_unit(F.lit(str(seed)), id_col) * len(words)).cast("int") + 1
    return df.withColumn("keyword", F.element_at(F.array(*map(F.lit, words)), at))
