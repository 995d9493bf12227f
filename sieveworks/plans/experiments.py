"""Studies over popularity subsets: one plan each, every subset carried along as a bucket instead of a job of its own."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import difficulty, index, metrics, networks, popularity, rank, relational, sampling, subset


def subset_runs(post: DataFrame, query: DataFrame, buckets: DataFrame, parts: int, k: int = 200) -> DataFrame:
    """(part, qid, id, score, rank): results filtered to each nested prefix, from one retrieval with full statistics.

    buckets: (id, bucket).  A document of bucket b belongs to subsets b..parts, so each query keeps the k best per subset.
    """
    scores = rank.combine(rank.term_scores(post, query)).join(buckets.select("id", "bucket"), "id")
    each = scores.withColumn("part", F.explode(F.sequence("bucket", F.lit(parts))))
    w = Window.partitionBy("part", "qid").orderBy(F.col("score").desc(), "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("part", "qid", "id", "score", "rank")


def subset_effectiveness(runs: DataFrame, qrels: DataFrame, k: int = 20) -> DataFrame:
    """(part, qid, p, rr) of each subset; queries without results in a subset count 0."""
    judged = runs.join(qrels.select("qid", "id", "rel"), ["qid", "id"])
    per = judged.groupBy("part", "qid").agg((F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)) / k).alias("p"), (1 / F.min("rank")).alias("rr"))
    frame = runs.select("part").distinct().crossJoin(F.broadcast(qrels.select("qid").distinct()))  # subsets times queries
    return frame.join(per, ["part", "qid"], "left").na.fill(0.0)


def index_subset(docs: DataFrame, weight: str, id_col: str, fields: dict[str, str], part: int, total: int, rest: bool = False, kind: str = "unigram") -> DataFrame:
    """Postings of the part / total most popular documents or, with ``rest``, of the others; statistics are the subset's own."""
    chosen = (subset.complement if rest else subset.prefix)(docs, weight, id_col, part, total)
    return index.postings(chosen, fields, id_col, kind)


def weighted_partition(docs: DataFrame, train: DataFrame, id_col: str, alpha: float, size: int) -> DataFrame:
    """The ``size`` documents with the largest smoothed weight, weights being the training queries' frequencies (id, freq)."""
    w = train.groupBy(F.col("id").alias(id_col)).agg(F.sum("freq").alias("pop"))
    weighted = popularity.laplace(popularity.fill_missing(docs, w, id_col, "pop"), alpha)
    return subset.cache_table(weighted, "smoothed", id_col, size)


def split_distributions(queries: DataFrame, share: float) -> DataFrame:
    """(text, train, test): counts of each query text on both sides of a random split of its instances."""
    inst = popularity.flatten(queries).withColumn("key", F.concat_ws("|", "qid", "instance"))
    parted = sampling.split(inst, "key", share)
    return parted.groupBy("text").agg(F.sum(F.col("train").cast("int")).alias("train"), F.sum((~F.col("train")).cast("int")).alias("test"))


def schema_capacity(queries: DataFrame, relevant: DataFrame, pattern: str, keep_keyword: bool, keyword_attribute: str = "semantic_type") -> DataFrame:
    """Queries whose text has the pattern and whose entity is in the table; the keyword leaves the text, or stays as an attribute."""
    found = queries.where(F.col("text").rlike(f"(?i){pattern}")).join(relevant.select("fbid"), "fbid", "left_semi")
    out = relational.remove_keyword(found, "text", pattern)
    return out.withColumnRenamed("keyword", keyword_attribute) if keep_keyword else out.drop("keyword")


def boost_shares(post: DataFrame, query: DataFrame, qrels: DataFrame, fields: list[str], k: int = 20) -> DataFrame:
    """(field, share): each field alone is searched; its share of the summed precision, averaged over queries."""
    scores = rank.term_scores(post.where(F.col("field").isin(fields)), query).groupBy("field", "qid", "id").agg(F.round(F.sum("score"), 6).alias("score"))
    w = Window.partitionBy("field", "qid").orderBy(F.col("score").desc(), "id")
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    p = top.join(qrels.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("field", "qid").agg((F.count("*") / k).alias("p"))
    share = p.withColumn("share", F.col("p") / F.sum("p").over(Window.partitionBy("qid")))
    n = share.select("qid").distinct().agg(F.count("*").alias("_n"))
    return share.groupBy("field").agg(F.sum("share").alias("s")).crossJoin(F.broadcast(n)).select("field", F.round(F.col("s") / F.col("_n"), 6).alias("share"))


def ltr_subsets(rows: DataFrame, parts: int, k: int = 10) -> DataFrame:
    """Learning-to-rank measures on the pages with most clicks: rows (qid, url_id, bm25, rel, clicks), one result per part."""
    urls = rows.groupBy("url_id").agg(F.max("clicks").alias("clicks"))
    buckets = subset.nested_buckets(urls, "clicks", "url_id", parts).select("url_id", "bucket")
    each = rows.join(buckets, "url_id").withColumn("part", F.explode(F.sequence("bucket", F.lit(parts))))
    w = Window.partitionBy("part", "qid").orderBy(F.col("bm25").desc(), "url_id")
    ranked = each.withColumn("rank", F.row_number().over(w)).withColumn("qid", F.struct("part", "qid"))
    return metrics.mslr(ranked.select("qid", "rank", "rel"), k).select("qid.part", "qid.qid", "pk", "recall_k", "mrr", "ap", "ndcg")


def cache_or_full(tokens: DataFrame, cache: DataFrame, rest: DataFrame, everything: DataFrame) -> DataFrame:
    """(qid, use_cache): likelihood choice between the postings of a cache and of the rest, both smoothed with all postings."""
    own = lambda p: difficulty.jelinek_mercer(tokens, index.term_stats(p), index.field_stats(p), index.term_stats(everything), index.field_stats(everything))
    return difficulty.choose_cache(own(cache), own(rest))


def cached_keyword_search(schema: networks.Schema, full: dict[str, DataFrame], cached: dict[str, DataFrame], posts: dict[str, DataFrame], cached_posts: dict[str, DataFrame], query: DataFrame, use_cache: dict[str, bool], n_keywords: int, n: int = 20, cap: int = 1000, cut: bool = False) -> DataFrame:
    """Keyword search with each relation read from its cache or in full."""
    pick = lambda a, b: {r: (b if use_cache.get(r) and r in b else a)[r] for r in a}
    tuples = {r: networks.tuple_set(p, query, cap, cut) for r, p in pick(posts, cached_posts).items()}
    return networks.search(schema, pick(full, cached), tuples, n_keywords, n)


def timed(steps: dict, repeats: int = 1) -> dict[str, float]:
    """Mean seconds of running each lazily built DataFrame to the end."""
    out = {}
    for name, build in steps.items():
        start = time.time()
        for _ in range(repeats):
            build().write.format("noop").mode("overwrite").save()
        out[name] = (time.time() - start) / repeats
    return out
