"""Sinks: indexes, result files, tables, topic XML, bridge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index
from ..operators.relational import wide
from ..operators.subset import cache_table, rest_table


def build_index(docs: DataFrame, path: str, fields: dict[str, str], id_col: str = "doc_id", kind: str = "unigram", mode: str = "overwrite", first: int | None = None, weight: str | None = None, lowest: bool = False) -> None:
    """Store postings and statistics of all documents, or of the ``first`` by weight (or of the lowest)."""
    if first is not None:
        docs = (rest_table if lowest else cache_table)(docs, weight or id_col, id_col, first)
    index.write_index(index.postings(docs, fields, id_col, kind), f"{path}/postings", mode)
    post = docs.sparkSession.read.parquet(f"{path}/postings")
    index.term_stats(post).write.mode(mode).parquet(f"{path}/term_stats")
    index.field_stats(post).write.mode(mode).parquet(f"{path}/field_stats")


def concat_attributes(df: DataFrame, id_col: str, attributes: list[str], weight: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.concat_ws(" ", *attributes).alias("text"), F.col(weight).cast("long").alias("weight"))


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def write_wide_csv(df: DataFrame, path: str, key: str, column: str, value: str, values: list) -> None:
    write_csv(wide(df, key, column, value, values), path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", bucket: tuple[int, str] | None = None) -> None:
    writer = df.write.mode(mode)
    if bucket:
        writer = writer.bucketBy(*bucket).sortBy(bucket[1])
    writer.saveAsTable(name)


def like_table(df: DataFrame) -> DataFrame:
    return df.limit(0)


def topic_xml(topics: DataFrame) -> DataFrame:
    """(value): a topic element per (qid, title, query)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return topics.select(F.format_string('<topic id="%d"><title>%s</title><query>%s</query></topic>', F.col("qid").cast("long"), esc("title"), esc("query")).alias("value"))


def keyword_query(creators: str, title: str):
    return F.trim(F.concat_ws(" ", creators, title))


def post_tags(posts: DataFrame, tags: DataFrame) -> DataFrame:
    """(post_id, tag_id): '<a><b>' strings split and looked up."""
    names = F.explode(F.split("tags", "[<>|]")).alias("tag_name")
    return posts.select(F.col("id").alias("post_id"), names).where("tag_name <> ''").join(tags.select(F.col("id").alias("tag_id"), "tag_name"), "tag_name").select("post_id", "tag_id").distinct()


def diagnostics(run: DataFrame, popularity: DataFrame) -> DataFrame:
    """(qid, line): rank, id and popularity of each result as one line."""
    j = run.join(popularity.select("id", "pop"), "id", "left")
    return j.select("qid", "rank", F.format_string("%d %s %s", F.col("rank").cast("long"), F.col("id").cast("string"), F.coalesce(F.col("pop").cast("string"), F.lit("-"))).alias("line"))
