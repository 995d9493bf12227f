"""The pipeline's stages on a small corpus with planted copies, passages and toxic documents."""

from __future__ import annotations

import random

import corpus_pipeline
from sieveworks.llm.registry import ORACLES, QUERIES
from test_llm_operators import join_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _corpus(path, spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    line = lambda n=14: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        lines = [line() for _ in range(5)]
        if i % 6 == 0:
            lines[2] += " grumbolt"
        rows.append([i, "\n".join(lines)])
        labels.append((i, 1, int(i % 6 == 0)))
    rows.append([300, rows[1][1]])  # an exact copy
    w = " ".join(line(300).split("\n")).split(" ")
    rows += [[301, " ".join(w)], [302, " ".join([*w[:150], "changed", *w[151:]])]]
    passage = line(60)
    rows += [[303, line() + " " + passage + " " + line()], [304, line() + " " + passage + " " + line()], [305, None], [306, ""]]
    full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return passage


def test_stages(spark, tmp_path):
    passage = _corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i in range(300) if i % 6} | set(range(300, 307))
    assert len(clean - set(seen["toxicity"])) <= 3 and len(set(seen["toxicity"]) - clean) <= 5
    assert 300 not in seen["line_dedup"] and {301, 302, 305, 306} <= set(seen["line_dedup"])
    assert 302 not in seen["ngram_jaccard"] and 301 in seen["ngram_jaccard"]
    assert passage in seen["suffix_dedup"][303] and passage[60:] not in seen["suffix_dedup"][304]
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(seen["suffix_dedup"])


def test_registry():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_line_stage_makes_no_rows_of_pairs(spark):
    """Documents quote a passage of three lines once, without its second line or twice: rows grow with documents, not with pairs."""
    rng = random.Random(23)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    p, own = [line() for _ in range(3)], [line() for _ in range(240)]
    whole, part = "\n".join(p), f"{p[0]}\n{p[2]}"
    rows = [(i, f"{own[i]}\n{whole}" if i < 70 else f"{own[i]}\n{part}" if i < 140 else f"{whole}\n{own[i]}\n{whole}") for i in range(240)]
    rows += [(1000 + i, own[i]) for i in range(240)]  # so that no two have the same shared lines; these lose all
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got == {i: rows[0][1] if i == 0 else f"{own[i]}\n{whole}" if i == 140 else own[i] for i in range(240)}
    assert 0 < join_rows(spark, since) < 10 * len(rows)
