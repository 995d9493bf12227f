"""Queries of the training-data operators, with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table



def op3_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media_gif

    return media_gif.read_payloads(media_gif.encode_payloads(table(spark, sf_dir, "documents")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import unigram

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = unigram.Model(f.read())
    docs = unigram.encode(table(spark, sf_dir, "documents"), model)
    back = unigram.decode(docs, model)
    return back.withColumn("decoded_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256)).drop("decoded")


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels)).withColumn("held_out", held_out(F.col("doc_id")))


def op10_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held_out", held_out(F.col("doc_id")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    from .common import materialize

    archives = materialize(warc.write(table(spark, sf_dir, "pages")), "warc")
    return warc.page_report(warc.reassemble(warc.records(archives)))


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(coalesce(decode(body), '')) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM d LEFT JOIN k ON d.digest = k.digest AND d.n >= 1000
"""


def op8_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vptree

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.search(vectors, vectors.where("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")


OP8_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


#: Words are runs of ASCII letters and digits and of non-ASCII characters; brute force over all pairs that share an n-gram.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
e AS (SELECT a, b, count(*) = max(n) AND max(n) = max(m) AS same FROM (SELECT p.a, p.b, x.n, y.n AS m FROM p JOIN t x ON x.doc_id = p.a JOIN t y ON y.doc_id = p.b AND x.g = y.g) GROUP BY a, b),
r AS (SELECT doc_id AS id, doc_id AS v FROM documents UNION SELECT r.id, p.b FROM r JOIN p ON r.v = p.a)
SELECT d.doc_id, (SELECT min(v) FROM r WHERE r.id = d.doc_id) AS class_id,
  coalesce((SELECT min(b) FROM e WHERE e.a = d.doc_id AND same AND b < d.doc_id), d.doc_id) AS copy_id,
  (SELECT count(*) FROM p WHERE p.a = d.doc_id) AS n_links
FROM documents d
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linedup

    docs = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed_lines", F.length("text").alias("n_chars_kept"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_line_dedup, op3_media_gif, op4_sentencepiece, op5_quality_fm, op6_best_fit_packing, op7_warc, op8_vantage_point, op9_suffix_dedup, op10_toxicity_mil)}
ORACLES: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op7_warc": OP7_SQL, "op8_vantage_point": OP8_SQL}
