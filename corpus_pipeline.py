"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` cuts lineage between stages with tables in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import linedup, ngram_join, packing, suffix_dedup, toxicity
from sieveworks.llm.common import materialize, table


def _rewritten(docs: DataFrame, rewrite) -> DataFrame:
    """docs with the texts that rewrite makes, n_chars brought up to date; documents that lost all their text go."""
    had = "had_text"
    while had in docs.columns:
        had += "_"
    after = rewrite(docs.withColumn(had, F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))))
    lost = F.col(had) & (F.length(F.trim("text")) == 0)
    return after.where(~lost).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model rejects go; it learns from the labelled documents that are still there."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks of lines go from the later of two overlapping documents."""
    return _rewritten(docs, lambda d: linedup.dedup_lines(d, counts=False))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by an n-gram Jaccard similarity of 0.8 or more, the one with the smallest id stays; rows without links all stay."""
    linked = ngram_join.join(docs.select("doc_id", "text")).where("n_links > 0")
    linked = linked.select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("key"), "stays").distinct()
    # the columns stay in a struct, so that no name can clash
    rows = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = rows.join(linked, "key", "left").where(F.coalesce("stays", F.lit(True)))
    # of the repeated rows of a document that stays one is enough; each row without links has a number of its own
    number = F.when(F.col("stays").isNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    return judged.withColumn("number", number).dropDuplicates(["key", "number"]).select("row.*")


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 50 bytes that an earlier document has go."""
    return _rewritten(docs, lambda d: suffix_dedup.dedup(d, as_text=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs, packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", dedup_substrings),
    ("packing", pack),
]

#: Trained models, alignments and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
