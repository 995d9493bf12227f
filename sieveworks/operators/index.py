"""Inverted-index statistics as tables: postings, term, field and document statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyse

#: What Spark reads as one split unless it is told otherwise.
SPLIT_BYTES = 1 << 27


def spread(docs: DataFrame, id_col: str) -> DataFrame:
    """docs dealt over all cores by id if they are so small that a scan may leave cores idle; larger inputs stay as they are split.

    Postings are grouped by id among others, so what is dealt here isn't shuffled again for them.
    """
    context = docs.sparkSession.sparkContext
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(context.defaultParallelism, id_col) if size < context.defaultParallelism * SPLIT_BYTES else docs


def postings(docs: DataFrame, fields: dict[str, str], id_col: str = "doc_id", kind: str = "unigram") -> DataFrame:
    """(field, term, id, tf); fields maps index field names to columns.  Only the id and those columns are read."""
    docs = spread(docs.select(id_col, *dict.fromkeys(c for c in fields.values() if c != id_col)), id_col)
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), analyse(c, kind).alias("terms")) for f, c in fields.items()])) if len(fields) > 1 else None
    if parts is None:
        ((field, column),) = fields.items()
        flat = docs.select(F.col(id_col).alias("id"), F.explode(analyse(column, kind)).alias("term")).withColumn("field", F.lit(field))
    else:
        flat = docs.select(F.col(id_col).alias("id"), parts.alias("p")).select("id", F.col("p.field").alias("field"), F.explode("p.terms").alias("term"))
    return flat.groupBy("field", "term", "id").agg(F.count("*").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    """(field, term, df, ttf): postings are one row per term and document, so no distinct count is needed."""
    return post.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


def doc_lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("field", "id").agg(F.sum("tf").alias("dl"))


def field_stats(post: DataFrame, n_docs: DataFrame | None = None) -> DataFrame:
    """(field, n_docs, sum_df, sum_ttf, avgdl); n_docs counts documents with a term in the field."""
    per_doc = post.groupBy("field", "id").agg(F.count("*").alias("terms"), F.sum("tf").alias("dl"))
    return per_doc.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("terms").alias("sum_df"), F.sum("dl").alias("sum_ttf"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, qid: str, text: str, kind: str = "unigram", first: int | None = None) -> DataFrame:
    """(qid, term, qtf, pos) of every distinct query term, optionally of the first tokens only."""
    t = analyse(text, kind)
    t = F.slice(t, 1, first) if first else t
    flat = queries.select(F.col(qid).alias("qid"), F.posexplode(t).alias("pos", "term"))
    return flat.groupBy("qid", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("pos"))


def vocabulary(queries: DataFrame, text: str, kind: str = "unigram") -> DataFrame:
    return queries.select(F.explode(analyse(text, kind)).alias("term")).distinct()


def fields_of(post: DataFrame) -> DataFrame:
    return post.select("field").distinct()


def terms_of(post: DataFrame, field: str) -> DataFrame:
    return post.where(F.col("field") == field).select("term").distinct().orderBy("term")


def segments(path: str, spark) -> DataFrame:
    """Files of a stored index and their rows."""
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("segment")).agg(F.count("*").alias("rows"))


def write_index(post: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Postings partitioned by field and sorted by term, so that term filters skip row groups."""
    post.repartition("field", "term").sortWithinPartitions("term").write.mode(mode).partitionBy("field").parquet(path)
