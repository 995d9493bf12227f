"""Ranked retrieval: BM25 and TF-IDF over postings, boosts, operators, cut-offs."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import index

K1, B = 1.2, 0.75


def term_scores(post: DataFrame, query: DataFrame, boosts: dict[str, float] | None = None, similarity: str = "bm25", kept: DataFrame | None = None) -> DataFrame:
    """(qid, id, field, term, score, idf): contribution of each matching query term.

    ``kept`` are the statistics' postings when they differ from those searched.
    Postings are reduced to query terms before any join with statistics; lengths are joined last.
    """
    base = kept if kept is not None else post
    fs = index.field_stats(base)
    hit = post.join(query.select("qid", "term", "qtf"), "term")
    df = base.join(query.select("term").distinct(), "term", "left_semi").groupBy("field", "term").agg(F.count("*").alias("df"))
    hit = hit.join(df, ["field", "term"]).join(index.doc_lengths(post), ["field", "id"]).join(F.broadcast(fs), "field")  # a row per field
    boost = F.lit(1.0)
    for f, b in (boosts or {}).items():
        boost = F.when(F.col("field") == f, F.lit(float(b))).otherwise(boost)
    if similarity == "bm25":
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    elif similarity == "tfidf":
        idf = 1 + F.log((F.col("n_docs") + 1) / (F.col("df") + 1))
        gain = F.sqrt("tf") * idf * idf / F.sqrt("dl")
    elif similarity == "boolean":
        idf, gain = F.lit(1.0), F.lit(1.0)
    else:
        raise ValueError(similarity)
    return hit.select("qid", "id", "field", "term", (F.col("qtf") * boost * gain).alias("score"), idf.alias("idf"))


def combine(scores: DataFrame, operator: str = "or", query: DataFrame | None = None) -> DataFrame:
    """(qid, id, score): sums over terms; AND keeps documents in which every query term matches some field."""
    out = scores.groupBy("qid", "id").agg(F.round(F.sum("score"), 6).alias("score"), F.count_distinct("term").alias("matched"))
    if operator == "and":
        need = query.groupBy("qid").agg(F.count_distinct("term").alias("need"))
        out = out.join(need, "qid").where("matched = need")
    return out.select("qid", "id", "score")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank); ties go to the smaller id."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(post: DataFrame, query: DataFrame, k: int = 200, boosts: dict[str, float] | None = None, similarity: str = "bm25", operator: str = "or", kept: DataFrame | None = None) -> DataFrame:
    return top_k(combine(term_scores(post, query, boosts, similarity, kept), operator, query), k)


def _gain(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _above(words: list[str], ids: list, queries: list[dict], avgdl: float) -> list[list[int]]:
    """For each query and each of its items: how many of these documents rank above the item."""
    need = {t for q in queries for t in q["terms"]}
    at, tf, dl = defaultdict(list), defaultdict(list), np.empty(len(words))
    for d, w in enumerate(words):
        w = w.split(" ")
        dl[d] = len(w)
        for t, n in Counter(w).items():
            if t in need:
                at[t].append(d)
                tf[t].append(n)
    post = {t: (i := np.array(x, np.intp), _gain(np.array(tf[t], float), dl[i], avgdl)) for t, x in at.items()}
    out, score = [], np.empty(len(words))
    for q in queries:
        score[:] = 0
        for t, weight in zip(q["terms"], q["weights"]):
            if t in post:
                where, gain = post[t]
                score[where] += weight * gain
        rounded = np.rint(score * 1e6)
        n = []
        for item, own in zip(q["ids"], q["scores"]):
            level = np.rint(own * 1e6)
            n.append(int(np.count_nonzero(rounded > level)) + sum(ids[d] < item for d in np.flatnonzero((rounded == level) & (score > 0))))
        out.append(n)
    return out


def item_ranks(docs: DataFrame, id_col: str, text_col: str, query: DataFrame, items: DataFrame, k: int = 200, shard_tokens: int = 1 << 20, block: int = 4096) -> DataFrame:
    """(qid, id, rank): the rows for ``items`` (qid, id) that ``search`` of one field has among its first k.

    An item's rank is the number of documents above it, so no score per query and document is kept.  Documents are dealt
    into shards and added up shard by shard, in passes over more and more of them; an item with k documents
    above it is not among the first k whatever the others are, and takes no further part.
    """
    spark = docs.sparkSession
    n_qid, n_id = query.schema["qid"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    flat = index.spread(docs.select(id_col, text_col), id_col).select(F.col(id_col).alias("id"), F.array_join(tokens(text_col), " ").alias("w"))
    words = flat.where("w <> ''").groupBy("id").agg(F.array_join(F.collect_list("w"), " ").alias("w"))
    n_docs, avgdl, total = words.select(F.size(F.split("w", " ")).alias("dl")).agg(F.count("*"), F.avg("dl"), F.sum("dl")).first()
    items = items.select("qid", "id").where("qid IS NOT NULL AND id IS NOT NULL").distinct()
    if not n_docs:
        return items.limit(0).select("qid", "id", F.lit(1).alias("rank"))
    df = words.select(F.explode(F.array_distinct(F.split("w", " "))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = query.join(items.select("qid").distinct(), "qid", "left_semi").select("qid", "term", "qtf").join(df, "term")
    weight = F.col("qtf") * F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    vectors = asked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("v"))
    vectors = vectors.select("qid", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))

    def own(batches):
        for b in batches:
            scores = []
            for w, terms, weights in zip(*(b.column(c).to_pylist() for c in ("w", "terms", "weights"))):
                w = w.split(" ")
                tf, score = Counter(w), 0.0
                for t, x in zip(terms, weights):
                    if t in tf:
                        score += x * float(_gain(np.float64(tf[t]), np.float64(len(w)), avgdl))
                scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("id"), pa.array(scores, pa.float64())], ["qid", "id", "score"])

    def count(first):
        def counted(left, right):
            left, names = left.drop_columns(["block"]), ["qid", "terms", "weights", "ids", "scores", "above"]
            rows = left.to_pylist()
            found = _above(right["w"].to_pylist(), right["id"].to_pylist(), rows, avgdl) if rows else []
            for r, n in zip(rows, found):
                if r["shard"] == first:  # what all shards have of a query is kept once
                    r["above"] = [x + y for x, y in zip(r["above"], n)]
                else:
                    r |= dict.fromkeys(("terms", "weights", "ids", "scores")) | {"above": n}
            kinds = ((c, left.schema.field(c).type) for c in names)
            return pa.Table.from_pylist(rows, schema=pa.schema([(c, pa.list_(k.value_type) if pa.types.is_list(k) else k) for c, k in kinds]))

        return counted

    scored = items.join(vectors, "qid").join(words, "id").select("qid", "id", "w", "terms", "weights").mapInArrow(own, f"qid {n_qid}, id {n_id}, score double").where("score > 0")
    scored = scored.groupBy("qid").agg(F.collect_list(F.struct("id", "score")).alias("i")).select("qid", F.col("i.id").alias("ids"), F.col("i.score").alias("scores"))
    schema = f"qid {n_qid}, terms array<string>, weights array<double>, ids array<{n_id}>, scores array<double>, above array<long>"
    state = vectors.join(scored, "qid").withColumn("above", F.transform("ids", lambda _: F.lit(0).cast("long")))
    n_shards = -(-total // shard_tokens)
    done = 0
    while done < n_shards:
        upto = min(max(16 * done, 1), n_shards)
        state = state.localCheckpoint()  # few rows after the first pass, and their number tells into how many blocks they go
        blocks = -(-state.count() // block) or 1
        q = state.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))))
        d = words.where("id IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")).where(F.col("shard").between(done, upto - 1))
        d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        found = q.groupBy("shard", "block").cogroup(d.groupBy("shard", "block")).applyInArrow(count(done), schema)
        if upto - done > 1:
            add = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("long")) + y)
            kept = [F.first(c, ignorenulls=True).alias(c) for c in ("terms", "weights", "ids", "scores")]
            found = found.groupBy("qid").agg(*kept, F.aggregate(F.collect_list("above"), F.array().cast("array<long>"), add).alias("above"))
        state = found.where(F.array_min("above") < k)
        done = upto
    out = state.select("qid", F.explode(F.arrays_zip("ids", "above")).alias("x"))
    return out.select("qid", F.col("x.ids").alias("id"), (F.col("x.above") + 1).cast("int").alias("rank")).where(F.col("rank") <= k)


def mix(title: str, content: str, gamma: float = 0.15) -> dict[str, float]:
    return {title: gamma, content: 1 - gamma}


def attribute_search(post: DataFrame, queries: dict[str, DataFrame], k: int = 100) -> DataFrame:
    """Each field has a query of its own; contributions are summed."""
    parts = [term_scores(post.where(F.col("field") == f), q) for f, q in queries.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(combine(out), k)


def popularity_boost(scores: DataFrame, weights: DataFrame, id_col: str = "id", weight: str = "weight") -> DataFrame:
    """ln(score) + ln(weight); weight 0 or unknown counts as 1."""
    w = weights.select(F.col(id_col).alias("id"), F.col(weight).cast("double").alias("_w"))
    joined = scores.join(w, "id", "left").withColumn("_w", F.when(F.coalesce("_w", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_w")))
    return joined.where("score > 0").withColumn("score", F.round(F.log("score") + F.log("_w"), 6)).drop("_w")


def relative_cut(run: DataFrame, share: float = 0.5) -> DataFrame:
    """Results down to and including the first one below share times the top score."""
    w = Window.partitionBy("qid").orderBy("rank")
    top = F.first("score").over(w)
    before = F.lag("score").over(w)
    return run.withColumn("_top", top).withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") >= share * F.col("_top"))).drop("_top", "_before")


def idf_list(scores: DataFrame) -> DataFrame:
    """(qid, id, idfs): idf of the matched terms, by term."""
    pair = F.array_sort(F.collect_list(F.struct("term", F.round("idf", 6).alias("idf"))))
    return scores.groupBy("qid", "id").agg(F.array_join(F.transform(pair, lambda p: F.concat(p["term"], F.lit(":"), p["idf"].cast("string"))), " ").alias("idfs"))


def phrase_hits(biword_post: DataFrame, pairs: DataFrame, cap: int = 10000) -> DataFrame:
    """(term, hits): documents with the two words side by side, counted up to cap."""
    hits = biword_post.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return pairs.select("term").distinct().join(hits, "term", "left").select("term", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).cast("long").alias("hits"))


def lookup(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """(id, hits): how many documents have exactly that id."""
    n = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    return ids.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("hits"))
