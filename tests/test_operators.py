"""Operators on small inputs with results worked out by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sieveworks.functions import text as T
from sieveworks.operators import difficulty, index, learn, metrics, networks, popularity, rank, relational, sampling, subset
from sieveworks.sources import markup, sinks, tables
from sieveworks.sources import text as lines
from sieveworks.streaming.popularity import windowed_counts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def text(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_tokens_and_biwords(spark):
    df = spark.createDataFrame([("Six feet-down, ÉTÉ 2!",), (None,), ("one",)], "t string")
    assert [tuple(r) for r in df.select(T.tokens("t"), T.biwords("t")).collect()] == [(["six", "feet", "down", "été", "2"], ["six feet", "feet down", "down été", "été 2"]), ([], []), (["one"], [])]


def test_scalars(spark):
    df = spark.createDataFrame([("a/b/x.y.xml", "$1,234.50", "2005-08-01", "910.4", '{"a": 1, "b": 2.5}', "&lt;b&gt; &amp;amp;")], "p string, price string, d string, dewey string, j string, h string")
    got = df.select(T.stem_of_path("p"), T.price("price"), T.year("d"), T.dewey_class("dewey"), T.json_sum("j"), T.unescape("h"), T.before_last("p", "/"), T.after_last("p", "/")).first()
    assert tuple(got) == ("x.y", 1234.5, "2005", "910", 3.5, "<b> &amp;", "a/b", "x.y.xml")
    assert T.keyword_subsets(["a", "b"]) == [(), ("a",), ("b",), ("a", "b")]
    m = spark.createDataFrame([([[1, 2], [3, 4]], [[1, 1], [1, 1]])], "a array<array<int>>, b array<array<int>>")
    assert m.select(T.add_matrices("a", "b")).first()[0] == [[2, 3], [4, 5]]


def test_line_sources(spark, tmp_path):
    assert rows(lines.parse_path_list(text(spark, "/i1.xml, 10", "bad", "/a.xml,3.5, A, title", "/b.xml,x"))) == [("/a.xml", 3.5, "A, title"), ("/i1.xml", 10.0, "")]
    assert rows(lines.parse_popularity(text(spark, "a/b/15580374.xml, 579193830.0, T", "x", "q/0812532538.txt,3655"))) == [("0812532538", 3655.0), ("15580374", 579193830.0)]
    assert rows(lines.parse_qrels(text(spark, "1 Q0 qrel1 10", "1 Q0 qrel2 1", "1 Q0 qrel3 0", "10 Q0 qrel1 1", "1 Q0 qrel2 1"))) == [(1, "qrel1", 10), (1, "qrel2", 1), (10, "qrel1", 1)]
    assert rows(lines.parse_queries(text(spark, 'new, "york" 12', "nothing"))) == [(12, "new york")]
    log = tmp_path / "log.txt"
    log.write_text("# 3 ----\n# wikiID : A\n# frequency : 2\n# entityID : 5\nsome text\n# 4 ---\n# wikiID : B\n# wikiID : C\n# frequency : 1\n# frequency : 4\n# entityID :\nother\n")
    assert rows(lines.query_blocks(spark, str(log))) == [(3, "some text", 2, ["A"]), (4, "other", 5, ["B", "C"])]
    assert rows(lines.repair_csv(text(spark, "a,b,c,d", "a,b", "x,y,z"), 3)) == [(["a b", "c", "d"],), (["x", "y", "z"],)]
    assert rows(lines.parse_title_votes(text(spark, "Game (VG);5;1", "bad;x;1", "Film;7;2"))) == [("Film", 7), ("Game", 5), ("Game (VG)", 5)]
    assert rows(lines.parse_ratings(text(spark, "u,i1,2,0", "u,i1,3,0"))) == [("i1", 2.5, 2)]
    assert rows(lines.parse_page_views(text(spark, "en New_York 5 100", "de X 1 1"))) == [("New York", 5)]
    assert rows(lines.parse_sales(text(spark, "{'asin': 'a', 'title': 't', 'salesRank': {'Books': 10}}", "{'asin': 'b', 'title': 'u'}"))) == [("a", "t", 14999990), ("b", "u", -1)]
    d = tmp_path / "dewey.tsv"
    d.write_text("910   Geography & travel\n004   Data\n")
    assert rows(lines.dewey(spark, str(d))) == [("004", "Data"), ("910", "Geography & travel")]
    q = spark.createDataFrame([("a / b",), ("c",), ("z",)], "text string")
    known = spark.createDataFrame([("a/b", 1), ("c", 2)], "text string, qid int")
    assert rows(lines.qid_lookup(q, known)) == [("a / b", 1), ("c", 2)]


BOOK = """<?xml version="1.0"?><!DOCTYPE book SYSTEM "books.dtd"><book><title>My Room</title><binding>Paperback</binding><listprice>$10.95</listprice>
<publicationdate>2005-08-01</publicationdate><dewey>910</dewey><numberofpages>200</numberofpages><images><image/><image/></images><reviews><review><rating>4</rating></review>
<review><rating>3</rating></review></reviews><creators><creator><name>A</name></creator><creator><name>B</name></creator></creators><tags><tag count="2">unread</tag><tag count="1">Fiction</tag></tags></book>"""


def test_markup(spark):
    f = spark.createDataFrame([("b1", BOOK)], "id string, value string")
    got = markup.book_features(f).first()
    assert (got.binding, got.price, got.year, got.dewey, got.pages, got.n_image, got.n_review, got.n_creator, got.n_rating, got.mean_rating) == ("Paperback", 10.95, "2005", "910", "200", 2, 2, 2, 2, 3.5)
    b = markup.books(f).first()
    assert (b.title, b.creators, b.tags, b.dewey, b.content) == ("My Room", "A B", "unread Fiction", "910", "Paperback $10.95 2005-08-01 200 4 3")
    assert markup.book_tags(f).first().tags == "unread unread Fiction"
    wiki = spark.createDataFrame([("1", '<article id="1" title="A &amp; B"><p>x <b>y</b></p></article>'), ("2", "<listitem>REDIRECT z")], "id string, value string")
    assert rows(markup.encyclopedia(wiki)) == [("1", "A & B", "x y")]
    old = spark.createDataFrame([("1", "<title>T\nU</title><p>body</p>"), ("2", "<p>REDIRECT x</p>")], "id string, value string")
    assert rows(markup.encyclopedia_09(old)) == [("1", "T U", "T U body")]
    movie = spark.createDataFrame([("m", "<movie><title>T</title><genre>G</genre><keywords>K</keywords><plot>P</plot><actors><actor>A</actor></actors><rating>7.5 (x)</rating></movie>")], "id string, value string")
    assert rows(markup.movies(movie)) == [("m", "T", "G K", "P", "A", "")] and rows(markup.movie_ratings(movie)) == [("m", 7.5)]
    topics = spark.createDataFrame([("t", '<topics><topic id="5"><title>a</title><castitle>b</castitle></topic><topic id="6"><title></title></topic></topics>')], "id string, value string")
    assert rows(markup.topics(topics, ("title", "castitle"))) == [(5, "a b")]


def test_retrieval_and_index(spark, tmp_path):
    d = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None)], "doc_id long, text string")
    p = index.postings(d, {"content": "text"})
    assert rows(index.term_stats(p).drop("field")) == [("a", 1, 2), ("b", 2, 2), ("c", 1, 1)]
    q = index.query_terms(spark.createDataFrame([(7, "a b")], "qid int, t string"), "qid", "t")
    run = rank.search(p, q, 5)
    idf = lambda df: math.log(1 + (2 - df + 0.5) / (df + 0.5))
    s = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2.5))
    assert rows(run.select("id", "score", "rank")) == [(1, round(idf(1) * s(2, 3) + idf(2) * s(1, 3), 6), 1), (2, round(idf(2) * s(1, 2), 6), 2)]
    assert [r.id for r in rank.search(p, q, 5, operator="and").collect()] == [1]
    sinks.build_index(d, str(tmp_path / "ix"), {"content": "text"})
    assert spark.read.parquet(str(tmp_path / "ix/term_stats")).count() == 3
    assert rows(index.terms_of(p, "content")) == [("a",), ("b",), ("c",)]
    both = rank.attribute_search(p, {"content": q}, 5)
    assert both.count() == 2
    assert rank.search(p.limit(0), q, 5).count() == 0


def test_metrics(spark):
    run = spark.createDataFrame([(1, "q2", 1), (1, "q1", 2)], "qid int, id string, rank int")
    rel = spark.createDataFrame([(1, "q1", 10)], "qid int, id string, rel int")
    m = metrics.core(run, rel).first()
    assert (m.p10, m.mrr, m.ap, m.ndcg10, m.ap_ref) == (0.1, 0.5, 0.5, round(1 / math.log2(3), 6), 0.5)
    assert rows(metrics.false_negatives(run, rel, 1)) == [(1, "q1", 10)]
    ltr = spark.createDataFrame([(1, i + 1, r) for i, r in enumerate([5, 5, 1, 0])], "qid int, rank int, rel int")
    g = metrics.mslr(ltr).first()
    assert (g.pk, g.mrr, g.ap, g.ndcg) == (0.2, 1.0, 1.0, 1.0)
    remapped = metrics.remap(spark.createDataFrame([(1, f"is{i}", i) for i in range(1, 6)], "qid int, id string, rank int"), spark.createDataFrame([("is1", "lt1"), ("is2", "lt1"), ("is3", "lt1"), ("is4", "lt2")], "id string, to string"))
    assert rows(remapped.select("rank", "id")) == [(1, "lt1"), (2, "lt2")]


def test_subsets(spark):
    d = spark.createDataFrame([(i, i * i % 11) for i in range(23)], "id int, w int")
    want = {i: k + 1 for k, (_, i) in enumerate(sorted((-(i * i % 11), i) for i in range(23)))}
    assert {r.id: r.rn for r in subset.global_rank(d, "w", "id", buckets=4).collect()} == want
    assert subset.prefix(d, "w", "id", 1, 2).count() == 11 and subset.complement(d, "w", "id", 1, 2).count() == 12
    c = spark.createDataFrame([(1, 10), (2, 9), (3, 5), (4, 1), (5, 0)], "id int, n int")
    assert [t for _, t in rows(subset.step_thresholds(c, 2, "n", "id"))] == [5, 0]
    assert rows(subset.global_thresholds(c.withColumnRenamed("n", "pop"), 2)) == [(1, 9), (2, 0)]
    best, value = subset.greedy_cache({"a": [0.5, 0.3], "b": [0.4]}, lambda t: {(1, 0): 0.1, (1, 1): 0.3, (2, 1): 0.2}[t["a"], t["b"]], "a")
    assert best == {"a": 1, "b": 1} and value == 0.3


def test_predictors(spark):
    q = spark.createDataFrame([(1, 0, "hanhan")], "qid int, pos int, term string")
    s = spark.createDataFrame([("hanhan", 1, 2)], "term string, df long, ttf long")
    t = spark.createDataFrame([(1, 4, 6)], "n_docs long, sum_df long, sum_ttf long")
    assert difficulty.clarity(q, s, t).first().clarity == round(1 + math.log(2), 6)
    assert difficulty.language_model(q, s, t).first().ln_lm == round(math.log(0.3), 6)
    g, gt = spark.createDataFrame([("hanhan", 1, 3)], "term string, df long, ttf long"), spark.createDataFrame([(1, 4, 8)], "n_docs long, sum_df long, sum_ttf long")
    assert difficulty.jelinek_mercer(q, s, t, g, gt).first().ln_jm == round(math.log(0.3375), 6)


def test_networks(spark):
    star = networks.Schema.parse("5 A AI I AL L AI A AI I AL A AL L")
    counts = [len(networks.networks(star, {"A", "I", "L"}, k, 5)) for k in (1, 2, 3, 4)]
    assert counts == [3, 10, 15, 15]
    assert len(networks.networks(star, {"A", "I", "L"}, 3, 5, cap=4)) == 4
    rel = {n: networks.Relation(n, "id") for n in ("A", "AI", "I")}
    schema = networks.Schema(rel, [networks.ForeignKey("AI", "a_id", "A", "id"), networks.ForeignKey("AI", "i_id", "I", "id")])
    tabs = {"A": spark.createDataFrame([(1,), (2,)], "id long"), "I": spark.createDataFrame([(10,), (11,)], "id long"), "AI": spark.createDataFrame([(1, 1, 10), (2, 2, 11), (3, 1, 11)], "id long, a_id long, i_id long")}
    ts = {"A": spark.createDataFrame([(1, 1, 3.0)], "qid int, id long, score double"), "I": spark.createDataFrame([(1, 10, 1.5), (1, 11, 0.9)], "qid int, id long, score double")}
    top = networks.search(schema, tabs, ts, 2, 10, 4).orderBy("rank").collect()
    assert [round(r.score, 6) for r in top[:3]] == [3.0, 1.5, 1.5] and top[0].id.startswith("A:1 |")
    bounded = networks.search_bounded(schema, tabs, ts, 2, 3, 4)
    assert [r["score"] for r in bounded] == [r.score for r in top[:3]]
    assert rows(networks.result_roots(networks.search(schema, tabs, ts, 2, 1, 4), "A")) == [(1, 1, "1")]


def test_relational_and_popularity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([("x",)], "v string")
    assert rows(relational.not_in(a, "v", b, "v")) == [(2, "y")]
    assert relational.not_in(a, "v", b.union(spark.createDataFrame([(None,)], "v string")), "v").count() == 0
    dup = spark.createDataFrame([(1, 1, 2), (3, 3, 4)], "a int, b int, c int")
    assert relational.unique_columns(dup).columns == ["a", "c"]
    q = relational.remove_keyword(spark.createDataFrame([("Batman Movie 1989",), ("none",)], "text string"), "text", "movie|film")
    assert rows(q) == [("batman 1989", "movie")]
    assert rows(popularity.flatten(spark.createDataFrame([("a", 2), ("b", 0)], "q string, freq int"))) == [("a", 2, 0), ("a", 2, 1)]
    posts = spark.createDataFrame([(1, "<x><y>"), (2, None)], "id int, tags string")
    assert rows(sinks.post_tags(posts, spark.createDataFrame([(5, "x"), (6, "z")], "id int, tag_name string"))) == [(1, 5)]
    qs = spark.createDataFrame([(1, "t", 3, [4, 5], 4), (2, "u", 1, [], 9)], "id int, text string, test_views int, all_answers array<int>, accepted int")
    assert rows(tables.question_queries(qs).select("qid", "answer")) == [(1, 4), (1, 5), (2, 9)]


def test_sampling(spark):
    d = spark.createDataFrame([(i, i) for i in range(50)], "id int, n int")
    s = sampling.without_replacement(d, "id", "n", 300)
    got = {r.id: r.sampled for r in s.collect()}
    assert sum(got.values()) == 300 and all(got[i] <= i for i in got)
    drawn = {r.id: r.sampled for r in sampling.with_replacement(d, "id", "n", 3000).collect()}
    assert sum(drawn.values()) == 3000 and abs(drawn[49] - 3000 * 49 / 1225) < 50
    parts = sampling.train_test(d, s, "id", "n")
    assert parts.where("train + test <> greatest(train, CAST(id AS BIGINT))").count() == 0
    f = sampling.folds(d.withColumn("c", F.col("id") % 2), "id", "c", 5)
    assert {r["count"] for r in f.groupBy("c", "fold").count().collect()} == {5}


def test_learning(spark):
    d = spark.createDataFrame([(float(i), float(i % 7), float(i > 50)) for i in range(100)], "a double, b double, label double")
    model = learn.classifier(["a", "b"], weight="weight").fit(learn.balanced(d, "label"))
    assert learn.predict(model, d).where("predicted = label").count() > 95
    assert len(learn.contributions(model, d, ["a", "b"]).first().contribution) == 2
    near = learn.nearest_classes(d, d.limit(5), ["a", "b"], "label", 3)
    assert near.where("p = 0").count() == 5
    assert learn.p_value(0.0) == 1.0
    # tables of the t distribution
    for t, n, p in ((2.0, 10, 0.0733880), (12.7062, 1, 0.05), (2.5706, 5, 0.05), (0.5, 3, 0.6514390), (1.96, 1e6, 0.0499957)):
        assert abs(learn.p_value(t, n) - p) < 2e-5
    assert learn.minmax(d.select("a"), ["a"]).agg(F.max("a")).first()[0] == 1.0


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-02 01:00:00")], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("SELECT user_id, n FROM counts")) == [(1, 2), (2, 1)]


def test_experiments(spark):
    from sieveworks.plans import experiments as X

    d = spark.createDataFrame([(1, "a a b", 5), (2, "b c", 9), (3, "a c", 1), (4, "c", 0)], "id long, text string, w int")
    p = index.postings(d, {"content": "text"}, "id")
    q = index.query_terms(spark.createDataFrame([(7, "a b")], "qid int, t string"), "qid", "t")
    rel = spark.createDataFrame([(7, 1, 1), (7, 3, 1)], "qid int, id long, rel int")
    buckets = subset.nested_buckets(d, "w", "id", 2)
    got = {(r.part, r.qid): (r.p, r.rr) for r in X.subset_effectiveness(X.subset_runs(p, q, buckets, 2), rel, 10).collect()}
    assert got == {(1, 7): (0.1, 1.0), (2, 7): (0.2, 1.0)}
    assert rows(X.index_subset(d, "w", "id", {"content": "text"}, 1, 2).select("id").distinct()) == [(1,), (2,)]
    assert rows(X.boost_shares(p, q, rel, ["content"])) == [("content", 1.0)]
    log = spark.createDataFrame([(1, "x", 10)], "qid int, text string, freq int")
    assert X.split_distributions(log, 0.5).selectExpr("train + test").first()[0] == 10
    ltr = spark.createDataFrame([(1, f"u{i}", float(10 - i), r, c) for i, (r, c) in enumerate([(5, 9), (0, 8), (4, 1)])], "qid int, url_id string, bm25 double, rel int, clicks int")
    assert [(r.part, r.mrr) for r in X.ltr_subsets(ltr, 3).orderBy("part").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    train = spark.createDataFrame([(3, 2), (3, 1)], "id long, freq int")
    assert X.weighted_partition(d, train, "id", 0.5, 1).first().id == 3
    fb = spark.createDataFrame([("m1", "Batman movie"), ("m2", "x")], "fbid string, text string")
    assert X.schema_capacity(fb, fb, "movie", True).first().semantic_type == "movie"
    tokens = difficulty.query_tokens(spark.createDataFrame([(7, "a b")], "qid int, t string"), "qid", "t")
    assert rows(X.cache_or_full(tokens, p.where("id = 1"), p.where("id > 1"), p)) == [(7, 1)]


def test_item_ranks_equal_search(spark):
    """Ranks of given documents without a run: ties, repeated ids, unmatched and unknown items, many shards and passes."""
    import random

    rng = random.Random(5)
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 40)}"
    docs = spark.createDataFrame([(i % 190, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(200)] + [(None, "w1 w2"), (900, "w0 w1"), (901, "W0, w1!"), (902, None)], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(rng.randrange(0, 5)))) for q in range(40)] + [(50, "w0 w1"), (51, "nowhere")], "qid long, text string")
    items = spark.createDataFrame([(q, i) for q in range(52) for i in rng.sample(range(190), 40)] + [(50, 900), (50, 901), (50, 5000), (None, 1)], "qid long, id long")
    terms = index.query_terms(asked, "qid", "text")
    want = rank.search(index.postings(docs, {"t": "text"}, "id"), terms, 15).join(items, ["qid", "id"]).select("qid", "id", "rank").distinct()
    want = {tuple(r) for r in want.collect()}
    for shard_tokens, block in ((1 << 20, 4096), (40, 7)):
        got = rank.item_ranks(docs, "id", "text", terms, items, 15, shard_tokens, block)
        assert len(want) > 30 and sorted(map(tuple, got.collect())) == sorted(want)


def test_cascade_match_shuffles_no_pairs(spark):
    """Each pair once, of keys and values with several titles as well; pairs are made after the last shuffle of their rows."""
    titles = ["a", "A", "a (x)", "a: y", "b (z)", "b", "c: 1", "c (2)", "", None]
    probe = [(i % 23, titles[i * 7 % 10]) for i in range(60)] + [(100, "a (q)"), (100, "b: r"), (101, "c"), (101, "a (q)"), (102, "c: q")]
    build = [(i % 19, titles[i * 3 % 10]) for i in range(45)]
    cut = lambda t: t.split(":")[0].split("(")[0].strip(" ")
    low = lambda rows: [(k, t.lower()) for k, t in rows if t is not None]
    want, left = set(), low(probe)
    for stage, (f, g) in enumerate([(str, str), (str, cut), (cut, cut)], 1):
        hit = {(k, v, stage) for k, t in left for v, u in low(build) if f(t) == g(u)}
        want, left = want | hit, [(k, t) for k, t in left if k not in {h[0] for h in hit}]
    out = relational.cascade_match(spark.createDataFrame(probe, "k long, title string"), spark.createDataFrame(build, "v long, title string"), "k", "title", "v")
    assert sorted(map(tuple, out.collect())) == sorted(want) and {s for *_, s in want} == {1, 2, 3}
    one = spark.range(2000).selectExpr("id AS k", "id AS v", "'t' AS title")
    out = relational.cascade_match(one, one, "k", "title", "v")
    assert out.where("stage = 1").count() == 4_000_000 and out.rdd.getNumPartitions() > 4


def test_cascade_match_holds_no_block_of_pairs(spark):
    """The first row of four million is there before thousands of pairs are made: generated code keeps all it makes of one input row."""
    one = spark.range(2000).selectExpr("id AS k", "id AS v", "'t' AS title")
    first = relational.cascade_match(one, one, "k", "title", "v").limit(1)
    assert len(first.collect()) == 1

    def nodes(plan):
        stage = plan.nodeName() == "ResultQueryStage"
        children = [plan.plan()] if stage else [plan.children().apply(i) for i in range(plan.children().size())]
        yield plan
        for child in children:
            yield from nodes(child)

    last = first._jdf.queryExecution().executedPlan().executedPlan()
    made = [n.metrics().apply("numOutputRows").value() for n in nodes(last) if n.nodeName() == "Generate"]
    assert len(made) > 1 and 0 < sum(made) < 100_000, made


def test_cascade_match_keeps_null_values(spark):
    probe, build = [(1, "a"), (2, "A (x)"), (3, "b: y")], [(None, "a"), (5, "a (z)"), (None, "b")]
    out = relational.cascade_match(spark.createDataFrame(probe, "k long, title string"), spark.createDataFrame(build, "v long, title string"), "k", "title", "v")
    assert set(map(tuple, out.collect())) == {(1, None, 1), (2, None, 3), (2, 5, 3), (3, None, 3)} and out.count() == 4
