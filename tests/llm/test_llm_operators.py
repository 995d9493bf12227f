"""The training-data operators against brute force and exact round trips, with the awkward inputs each docstring defines."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import reduce
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import hashing, linedup, media_gif, ngram_join, packing, quality, suffix_dedup, toxicity, unigram, vptree, warc
from sieveworks.llm.components import components

SCHEMA = "doc_id long, text string, lang string, tag string, id long"
EXTRA = ("en", "x", 7)  # columns that clash with internal names


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)


def prose(rng, words, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


AWKWARD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "é🎉 \x00 ▁ b"), (None, "text without id"), (5, "word " * 30000)]


# ---------------------------------------------------------------- GIF


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, bytes(70000), random.Random(1).randbytes(30000)])
def test_lzw_round_trip(data):
    assert media_gif.lzw_decode(media_gif.lzw_encode_many([data, b"xyz"])[0], 8, len(data)) == data


def test_lzw_deferred_clear_and_damage():
    # a stream that goes on with a full table: cut the clear codes of a long stream's only run
    data = bytes(range(256)) * 10
    stream = media_gif.lzw_encode_many([data])[0]
    assert media_gif.lzw_decode(stream[: len(stream) // 2], 8, len(data)) == data[: len(media_gif.lzw_decode(stream[: len(stream) // 2], 8, len(data)))]
    assert media_gif.lzw_decode(b"\xff\xff\xff", 8, 10) == b""


def _frame(box, samples, disposal=0, hidden=None, delay=5, interlaced=False):
    x, y, w, h = box
    gce = b"\x21\xf9\x04" + bytes([disposal << 2 | (hidden is not None)]) + delay.to_bytes(2, "little") + bytes([hidden or 0]) + b"\0"
    head = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([0x40 if interlaced else 0]) + b"\x08"
    return gce + head + media_gif._blocks(media_gif.lzw_encode_many([bytes(samples)])[0])


def test_gif_disposal_transparency_interlace():
    size = b"\x02\x00\x02\x00"
    frames = _frame((0, 0, 2, 2), [1, 2, 3, 4]) + _frame((0, 0, 2, 1), [9, 8], disposal=3, hidden=9) + _frame((1, 1, 1, 1), [7], disposal=2) + _frame((0, 0, 1, 1), [5])
    gif = b"GIF89a" + size + b"\xf7\0\0" + media_gif.GREY + frames + b"\x3b"
    seen = [(s, d, c[..., 0].ravel().tolist(), c[..., 3].ravel().tolist()) for s, d, _, c in media_gif.read_gif(gif)]
    assert seen == [(0, 50, [1, 2, 3, 4], [255] * 4), (50, 50, [1, 8, 3, 4], [255] * 4), (100, 50, [1, 2, 3, 7], [255] * 4), (150, 50, [5, 2, 3, 0], [255, 255, 255, 0])]
    tall = b"GIF89a\x01\x00\x09\x00\xf7\0\0" + media_gif.GREY + _frame((0, 0, 1, 9), [0, 8, 4, 2, 6, 1, 3, 5, 7], interlaced=True) + b"\x3b"
    assert next(iter(media_gif.read_gif(tall)))[3][:, 0, 0].tolist() == list(range(9))


def test_gif_payloads(spark):
    got = media_gif.read_payloads(media_gif.encode_payloads(docs(spark, AWKWARD))).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for i, t in AWKWARD:
        raw = (t or "").encode()
        by[i] = (len(raw), raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192)))
    for r in got:
        n, payload = by[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    media = media_gif.encode_payloads(docs(spark, AWKWARD[:3])).union(spark.createDataFrame([(9, 0, bytearray(b"no gif")), (10, 0, None)], "doc_id long, n_bytes long, media binary"))
    rows = {r.doc_id: r for r in media_gif.frames(media).collect()}
    assert rows[9].frame == rows[10].frame == -1 and sum(rows[1].histogram) == 3 * 192
    assert media_gif.read_payloads(media_gif.encode_payloads(docs(spark, []))).count() == 0


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return unigram.Model(f.read())


def _viterbi(model, text):
    """Exhaustive search over the whole text, without trie or stretches."""
    raw = (unigram.MARK + text.replace(" ", unigram.MARK)).encode() if text else b""
    ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == unigram.NORMAL}
    best = [(0.0, 0, 0)] + [(-np.inf, 0, 0)] * len(raw)
    starts = [i for i in range(len(raw)) if raw[i] & 0xC0 != 0x80]
    for s in starts:
        size = next((e for e in range(s + 1, len(raw)) if raw[e] & 0xC0 != 0x80), len(raw)) - s
        found = [(e, ids[raw[s:e]]) for e in range(s + 1, min(len(raw), s + 60) + 1) if raw[s:e] in ids]
        if not any(e - s == size for e, _ in found):
            found.append((s + size, model.unknown))
        for e, i in found:
            score = best[s][0] + (model.unknown_score if i == model.unknown else model.scores[i])
            if score > best[e][0]:
                best[e] = (score, s, i)
    out, at = [], len(raw)
    while at:
        _, s, i = best[at]
        out = ([model.byte_ids[b] for b in raw[s:at]] if i == model.unknown else [i]) + out
        at = s
    return out


def test_unigram_against_exhaustive(model):
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "héllo 🎉\n\nx", "日本語 テスト", "The theory of thistles", "a" * 300] + ["".join(rng.choice("abe tihs.é€") for _ in range(40)) for _ in range(60)]
    got = [np.frombuffer(x, "<i4").tolist() for x in model.encode(texts)]
    for t, ids in zip(texts, got):
        assert ids == _viterbi(model, t), t
        assert model.decode(ids) == t


def test_unigram_frames(spark, model):
    out = unigram.decode(unigram.encode(docs(spark, AWKWARD), model), model).collect()
    assert len(out) == len(AWKWARD)
    for r in out:
        texts = [t for i, t in AWKWARD if i == r.doc_id]
        assert r.decoded == (None if texts[0] is None else texts[0].replace("▁", " "))
    assert unigram.encode(docs(spark, []), model).count() == 0


# ---------------------------------------------------------------- classifiers


def _labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        parts = [prose(rng, 8) for _ in range(6)]
        if toxic:
            parts[rng.randrange(6)] += " " + rng.choice(["grumbolt", "snarkel", "vexo"])
        text = ". ".join(parts)
        if i % 7 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(i % 7 != 0), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_sentences(spark):
    d, labels = _labelled(spark)
    m = toxicity.fit(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d, m).collect()}
    unseen = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in unseen]) > 0.95
    spots = toxicity.offending_sentences(d, m).groupBy("doc_id").count().collect()
    assert np.mean([r.doc_id % 5 == 0 for r in spots]) > 0.95
    odd = {r.doc_id: r.score for r in toxicity.score(docs(spark, AWKWARD[:2]), m).collect()}
    assert odd == {1: 0.0, 2: 0.0}
    kept = toxicity.drop_toxic(d, m)
    assert kept.columns == d.columns and 0.75 < kept.count() / 600 < 0.85
    assert toxicity.score(docs(spark, AWKWARD), m).count() == len(AWKWARD) and toxicity.score(docs(spark, []), m).count() == 0
    assert toxicity.score(d, toxicity.fit(d, labels.limit(0))).where("predicted = 1").count() == 0


def test_noisy_or_by_hand():
    m = toxicity.Model(bias=-2.0)
    p = 1 / (1 + np.exp(2.0))
    assert np.allclose(m.scores(["a b. c!\nd", "", None, "a"]), [1 - (1 - p) ** 3, 0, 0, p])


def test_long_clean_text_is_not_toxic_by_length(spark):
    m = toxicity.fit(*_labelled(spark))
    harmless = "nothing said here.\n" * 60000
    assert m.scores([harmless]).tolist() == [0.0]
    assert m.scores([harmless + "w1 grumbolt w2."])[0] == m.scores(["w1 grumbolt w2."])[0] >= 0.5
    assert toxicity.fit(*(x.limit(0) for x in _labelled(spark))).scores([harmless]).tolist() == [0.0]


def test_quality_learns_and_matches_pairwise_sum(spark):
    d, labels = _labelled(spark)
    m = quality.fit(d, labels)
    got = {r.doc_id: r for r in quality.score(d, m).collect()}
    unseen = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 7 != 0) for i in unseen]) > 0.95
    text = "some words and, some more words."
    stats, _, bucket, value = quality.measure([text])
    ids, x = np.concatenate([m.one_hot(stats)[0], bucket]), np.concatenate([np.ones(quality.STATS), value])
    z = m.bias + m.linear[ids] @ x + sum(m.factors[a] @ m.factors[b] * u * v for (a, u), (b, v) in combinations(list(zip(ids, x)), 2))
    assert np.isclose(m.scores([text])[0], 1 / (1 + np.exp(-z)))
    assert quality.score(docs(spark, AWKWARD), m).where("score between 0 and 1").count() == len(AWKWARD)
    assert quality.score(docs(spark, []), quality.fit(d, labels.limit(0))).count() == 0


def test_separator_collision_falls_back():
    h, s, t = hashing.hashed_words(["a b. c", "", None, "d\x02e"], (4,))
    assert t.tolist() == [0, 0, 0, 3, 3] and s.tolist() == [0, 0, 1, 2, 2] and h.shape == (5, 2)


# ---------------------------------------------------------------- packing


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 16, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 80))), reverse=True)
        bins = []
        for it in items:
            fit = [(r, i) for i, r in enumerate(bins) if r >= it]
            if fit:
                bins[min(fit)[1]] -= it
            else:
                bins.append(capacity - it)
        counts = {x: items.count(x) for x in items}
        content: dict = {}
        for length, _, n, first, offset in packing.plan(counts, capacity):
            for k in range(n):
                content.setdefault(first + k, []).append((offset, length))
        assert len(content) == len(bins) and sum(map(len, content.values())) == len(items)
        for c in content.values():
            at = 0
            for offset, length in sorted(c):
                assert offset == at
                at += length
            assert at <= capacity


def test_open_bins_against_scan():
    rng, tree, count = random.Random(5), packing.OpenBins(37), [0] * 38
    for _ in range(2000):
        room = rng.randrange(38)
        n = rng.choice([1, 2, -count[room]])
        tree.add(room, n)
        count[room] += n
        need = rng.randrange(38)
        assert tree.tightest(need) == next((r for r in range(need, 38) if count[r]), -1)


def test_tokenizer_matches_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    hf = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = [t for _, t in AWKWARD if t] + ["a  b", "a \n b", "\n\na b\n", " x", "x  y ", "it's <|endoftext|> 5\t a", "a b c d"] + ["".join(rng.choice("ab 'st\n12.é") for _ in range(60)) for _ in range(200)]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Tokenizer(path).encode(texts)]
    assert got == [e.ids for e in hf.encode_batch(texts, add_special_tokens=False)]
    hf.encode_special_tokens = True
    assert np.frombuffer(packing.Tokenizer(path, special_as_text=True).encode(["a<|endoftext|>"])[0], "<u4").tolist() == hf.encode("a<|endoftext|>").ids


def test_pack_documents(spark):
    tok = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    rows = AWKWARD + [(100 + i, prose(rng, rng.randrange(400))) for i in range(60)]
    out = packing.pack_documents(docs(spark, rows), tok).collect()
    assert sum(r.length for r in out) == sum(len(np.frombuffer(x, "<u4")) + 1 for x in tok.encode([t or "" for _, t in rows]))
    by: dict = {}
    for r in out:
        assert r.length == 1024 or r.piece == 0
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for c in by.values():
        at = 0
        for offset, length in sorted(c):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs(spark, []), tok).count() == 0


# ---------------------------------------------------------------- WARC


def test_chunked_framing():
    for body in (b"", b"x" * 20000, bytes(range(256)) * 40):
        assert warc.unchunk(warc.chunked(body)) == body
    for bad in (b"", b"5\r\nab", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunk(bad)


def test_warc_round_trip(spark):
    big, small = "p" * 100000 + "é", "s" * 50
    rows = [(1, "u", big), (2, None, big), (3, "u\r\nX: y", small), (4, "u", small), (5, "u", None), (6, "u", big), (None, "u", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    found = warc.reassemble(warc.records(warc.write(pages)))
    got = {r.page_id: r for r in warc.page_report(found).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        keeper = 6 if html == big and i != 6 else None
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to, got[i].error) == (len(raw), hashlib.sha1(raw).hexdigest(), keeper, None)
        assert got[i].record_type == ("revisit" if keeper else "response")
    assert warc.page_report(warc.reassemble(warc.records(warc.write(pages.limit(0))))).count() == 0


def test_warc_rows_of_one_id(spark):
    a, b, c = "a" * 90000, "b" * 80000, "c" * 1200
    rows = [(1, a), (1, b), (1, b), (None, a), (None, c), (None, c), (None, "d" * 70000), (2, "x"), (2, "x"), (2, None)]
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in warc.page_report(warc.reassemble(warc.records(warc.write(pages)))).collect()]
    want = [(i, len(t or ""), hashlib.sha1((t or "").encode()).hexdigest(), *(("revisit", 1) if (i, t) == (None, a) else ("response", None)), None) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_broken_chains(spark):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + warc.chunked(b"y" * 100)
    first = warc.record("response", "a", block[:60], WARC_Segment_Number=1)
    rest = warc.record("continuation", "a2", block[60:], WARC_Segment_Origin_ID="<a>", WARC_Segment_Number=2, WARC_Segment_Total_Length=len(block))
    wrong = rest.replace(b"Total-Length: %d" % len(block), b"Total-Length: 7")
    lone = warc.record("continuation", "b2", b"z", WARC_Segment_Origin_ID="<b>", WARC_Segment_Number=2, WARC_Segment_Total_Length=9)

    def errors(*records):
        import gzip

        df = spark.createDataFrame([(bytearray(b"".join(gzip.compress(r) for r in records)),)], "archive binary")
        return [(r.error, None if r.payload is None else bytes(r.payload)) for r in warc.reassemble(warc.records(df)).collect()]

    assert errors(rest, first) == [(None, b"y" * 100)]
    assert errors(first) == [("total length differs", None)]
    assert errors(first, rest, rest) == [("segments missing or doubled", None)]
    assert errors(first, wrong) == [("total length differs", None)]
    assert errors(lone) == [("first segment missing", None)]


# ---------------------------------------------------------------- nearest neighbours


def _neighbours(rows, queries, k):
    out = {}
    for q, v in queries:
        plain = lambda w: reduce(lambda s, ab: s + float(ab[0]) * float(ab[1]), zip(v, w), 0.0)  # noqa: B023,E731  sum() would compensate
        scored = sorted((-plain(w), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_vantage_point_ties(spark):
    rng = np.random.default_rng(3)
    halves = [(i, [0.5, float(y)]) for i, y in enumerate(rng.permutation(np.arange(-150, 150) / 2), 1)]
    whole = [(1000 + i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(500)]
    whole = [(i, v) for i, v in whole if any(v)]
    rows = [(0, [1.0, 0.0]), *halves, *whole]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in vptree.search(df, df.where("vec_id % 20 = 0"), 20, shard_rows=128).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == _neighbours(rows, [x for x in rows if x[0] % 20 == 0], 20)


def test_vantage_point_trees(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [1.0, 2.0]), (None, [1.0] * 8), (2006, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    got: dict = {}
    for r in vptree.search(df, df.where("vec_id % 20 = 0"), 20, shard_rows=256, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = _neighbours(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert got == {q: v for q, v in want.items() if v}
    rough = vptree.search(df, df.where("vec_id % 20 = 0"), 20, factor=1.5, shard_rows=256).select("query_id", "id").collect()
    hits = sum((r.query_id in want and r.id in dict(want[r.query_id])) for r in rough)
    assert hits / sum(map(len, want.values())) > 0.5
    assert vptree.search(df.limit(0), df.limit(0)).count() == 0


# ---------------------------------------------------------------- line dedup


def test_patience_properties():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        got = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert linedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert linedup.patience([1, 5, 2, 3], [9, 1, 2, 7, 3]) == [(0, 1), (2, 2), (3, 4)]


def test_line_dedup(spark):
    rng = random.Random(10)
    line = [prose(rng, 12) for _ in range(12)]
    rows = [(1, "\n".join(line[:6])), (2, "\n".join([prose(rng, 12), *line[2:5], "tail"])), (3, "\n".join(line[:6])), (4, "short\nlines"), (5, "short\nlines"), (6, None), (7, ""), (None, "\n".join(line[:6])), (8, line[8] + " \n" + prose(rng, 12)), (9, line[8] + "\r\n" + line[9]), (9, line[9])]
    out = linedup.dedup_lines(docs(spark, rows))
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_lines", "n_removed_lines"]
    got = sorted(((r.doc_id or 0, r.n_removed_lines, r.text) for r in out.collect()), key=str)
    want = [(1, 0, rows[0][1]), (2, 3, rows[1][1].split("\n")[0] + "\ntail"), (3, 6, ""), (4, 0, rows[3][1]), (5, 0, rows[4][1]), (6, 0, None), (7, 0, ""), (0, 0, rows[7][1]), (8, 0, rows[8][1]), (9, 1, line[9]), (9, 0, line[9])]
    assert got == sorted(want, key=str)
    assert linedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_takes_short_and_blank_lines_along(spark):
    rng = random.Random(12)
    head, tail = prose(rng, 6), prose(rng, 6)
    copied = ["", head, "", "- one", "- two", "", tail, ""]
    rows = [(1, "\n".join([prose(rng, 12), *copied])), (2, "\n".join(["other", *copied, prose(rng, 12)]))]
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in linedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (8, "other\n" + rows[1][1].split("\n")[-1])}


def test_line_dedup_blocks_of_lines_with_other_first_holders(spark):
    rng = random.Random(13)
    x, y = prose(rng, 6), prose(rng, 6)
    verse = "\n".join(f"v{i} {i}" for i in range(9))
    rows = [(1, x + "\n" + prose(rng, 12)), (2, y + "\n" + prose(rng, 12)), (3, "\n".join(["b", x, y])), (4, "\n".join(["c", x, y])), (5, verse), (6, "d\n" + verse)]
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in linedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {**{i: (0, t) for i, t in rows}, 4: (2, "c"), 6: (9, "d")}


# ---------------------------------------------------------------- n-gram join


def _sets(texts):
    return [set(s.tolist()) for s in ngram_join.shingle_sets(texts)]


def test_ngram_join_runs_grow_with_the_depth_of_splits(spark, monkeypatch):
    # a simulated pair at the threshold, split at every level, stays apart in all runs with the chance that recall allows
    rng = random.Random(14)

    def meets(depth):
        return any(rng.random() < 0.8 and (not depth or meets(depth - 1)) for _ in range(1 + (rng.random() < 0.25)))

    for depth in (0, 2, 4):
        miss = sum(not meets(depth) for _ in range(20000)) / 20000
        assert miss ** ngram_join.runs_needed(0.8, 1 - 1e-6, depth) < 1.5e-6
    seen, search = [], ngram_join._search
    monkeypatch.setattr(ngram_join, "_search", lambda sets, runs, *a: seen.append(runs) or search(sets, runs, *a))
    passage = prose(rng, 60)
    ngram_join.join(docs(spark, [(i, passage + " " + prose(rng, 60)) for i in range(60)]), limit=4).count()
    assert seen[0] == range(8) and len(seen) > 1 and seen[-1].stop > 8


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, 60)) for i in range(40)]
    base = prose(rng, 200).split()
    for i in range(150):  # a group far over the limit of a small bucket, in blocks of its own
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(200)] = f"n{rng.random()}"
        rows.append((1000 + i, " ".join(w)))
    passage = " ".join(base[:40])
    rows += [(3000 + i, passage + " " + prose(rng, 80)) for i in range(90)]
    rows += [(5000, rows[0][1]), (5001, rows[0][1].upper()), (6000, ""), (6001, None), (6002, ""), (6003, "two words"), (6004, "two words"), (None, rows[0][1]), (6005, "x " * 30000)]
    got = {r.doc_id: r for r in ngram_join.join(docs(spark, rows), limit=16, block=32).collect()}
    ids, sets = [i for i, t in rows if i is not None], _sets([t for i, t in rows if i is not None])
    links = {i: set() for i in ids}
    for (a, x), (b, y) in combinations(zip(ids, sets), 2):
        if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    label = {}
    for i in sorted(ids):
        todo = [] if i in label else [i]
        while todo:
            v = todo.pop()
            if v not in label:
                label[v] = i
                todo += links[v]
    for i in ids:
        assert (got[i].class_id, got[i].n_links) == (label[i], len(links[i])), i
    assert got[None].class_id is None and got[None].n_links == 0
    assert ngram_join.join(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + k) for k in range(1, 100)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(150)]
    up = {v: v for e in edges for v in e}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


# ---------------------------------------------------------------- suffix dedup


def _brute(rows, length):
    first: dict = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for p in range(len(raw) - length + 1):
                w = raw[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for p in range(len(raw) - length + 1):
                if first[raw[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_windows_against_brute_force():
    rng = random.Random(13)
    for _ in range(40):
        length = rng.choice([4, 9, 50])
        strings = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 300))) for _ in range(10)]
        strings += [s[:40] + strings[0][20:200] + s[40:] for s in strings[:5]]
        owner = np.array([rng.randint(0, 6) for _ in strings])
        n, o = suffix_dedup.repeated_windows(strings, owner, length)
        first: dict = {}
        for s, d in zip(strings, owner):
            for p in range(len(s) - length + 1):
                first[s[p : p + length]] = min(first.get(s[p : p + length], 99), d)
        assert set(zip(n.tolist(), o.tolist())) == {(k, p) for k, (s, d) in enumerate(zip(strings, owner)) for p in range(len(s) - length + 1) if first[s[p : p + length]] < d}


@pytest.mark.parametrize("hot", [20000, 2])
def test_suffix_dedup_against_brute_force(spark, hot):
    rng = random.Random(14)
    rows = [(i, prose(rng, 60)) for i in range(30)]
    passage = prose(rng, 40)
    rows += [(100 + i, prose(rng, 10) + " " + passage + " é€ " + prose(rng, 10)) for i in range(20)]
    rows += [(200, rows[3][1]), (200, rows[3][1][:90]), (201, rows[3][1][10:]), (202, "ab" * 200), (203, "ab" * 150), *AWKWARD[:6], (300, rows[5][1][:49]), (301, rows[5][1][:50])]
    d = docs(spark, rows)
    ranges = suffix_dedup.removed_ranges(d, hot=hot)
    assert sorted((tuple(r) for r in suffix_dedup.cut(d, ranges).collect()), key=str) == _brute(rows, 50)
    text = suffix_dedup.cut(d, ranges, as_text=True)
    assert text.columns == d.columns and text.count() == len(rows)
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- names that clash


def test_rewriting_operators_keep_columns_of_any_name(spark):
    rng = random.Random(31)
    shared = "\n".join(prose(rng, 12) for _ in range(3))
    names = ["id", "hash", "key", "row", "gone", "removed", "_text", "_id", "_hash", "_gone", "_removed", "_chars", "n_lines", "n_removed_lines", "had_text"]
    rows = [(i, f"{prose(rng, 20)}\n{shared}" if i % 2 else None) for i in range(6)]
    d = spark.createDataFrame([(i, t, *range(10 * i, 10 * i + len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    want = {i: tuple(range(10 * i, 10 * i + len(names))) for i, _ in rows}
    for out in (linedup.dedup_lines(d, counts=False), suffix_dedup.dedup(d, as_text=True)):
        assert out.columns == d.columns
        got = {r[0]: (r[1], r[2:]) for r in out.collect()}
        assert {i: rest for i, (_, rest) in got.items()} == want
        assert got[1][0] == rows[1][1] and shared not in got[3][0] and got[0][0] is None
    counted = linedup.dedup_lines(d)
    assert sorted(counted.columns) == sorted(d.columns) and {(r.n_lines, r.n_removed_lines) for r in counted.where("doc_id = 3").collect()} == {(4, 3)}


def test_line_dedup_against_all_pairs(spark):
    """Every block of the minimum size that brute force over all pairs aligns goes, short and blank lines included."""
    rng = random.Random(41)
    stock = [prose(rng, n, 60) for n in (2, 3, 5, 7, 7, 8, 11, 14) for _ in range(4)] + ["", ""]
    rows = [(i, "\n".join([*(rng.choice(stock) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 9)) for _ in range(9))])) for i in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(6)] + [(200, "\n\n".join(stock[12:20])), (201, "x\n" + "\n\n".join(stock[12:20]) + "\ny")]

    def sliced(t):
        lines = [x.strip(" ") for x in t.split("\n")]
        body = b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in lines)
        return linedup.slices(body, np.array([len(x.split()) for x in lines], "<i4").tobytes(), 10)

    cut = {i: sliced(t) for i, t in rows}
    want = {}
    for i, t in rows:
        gone = {x for j, _ in rows if j < i for x in linedup.common_blocks(cut[j], cut[i], 10)}
        want[i] = len(gone)
    got = {r.doc_id: r.n_removed_lines for r in linedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[100] == rows[0][1].count("\n") + 1 and got[201] >= 7
    found, whole = sum(min(got[i], want[i]) for i in want), sum(want.values())
    assert whole > 50 and found >= 0.98 * whole and all(got[i] <= want[i] for i in want)


def test_line_dedup_tries_all_holders_of_a_common_run(spark):
    """Five earlier documents hold two lines in one order, of which alignment takes one; the next holds them in the other order."""
    rng = random.Random(43)
    p, q, own = prose(rng, 12), prose(rng, 12), [prose(rng, 12) for _ in range(14)]
    rows = [(i, "\n".join([own[i], q, "x", p])) for i in range(1, 7)] + [(7, "\n".join([p, "y", q])), (8, "\n".join(["z", p, "w", q, "v"]))]
    rows += [(100 + i, own[i]) for i in range(1, 7)]  # so that no two of the first six have the same shared lines
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in linedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[7][0] == 1 and got[8] == (2, "z\nw\nv")


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_equals_all_pairs(spark, seed):
    """Repeats, blank lines, copies and common lines in any order: what alignment of all pairs removes, line by line."""
    rng = random.Random(50 + seed)
    stock = [prose(rng, n, 60) for n in (4, 6, 10, 12, 15) for _ in range(2)] + ["", ""]
    rows = [(i, "\n".join(rng.choice(stock) if rng.random() < 0.75 else prose(rng, rng.randrange(1, 14)) for _ in range(rng.randrange(1, 12)))) for i in range(90)]
    rows += [(200 + k, rows[3 * k][1]) for k in range(10)] + [(300 + k, prose(rng, 14) + "\n" + rows[5 * k][1]) for k in range(10)]

    def sliced(t):
        body = b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in t.split("\n"))
        return linedup.slices(body, np.array([len(x.split()) for x in t.split("\n")], "<i4").tobytes(), 10)

    cut = {i: sliced(t) for i, t in rows}
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in {y for j, _ in rows if j < i for y in linedup.common_blocks(cut[j], cut[i], 10)}) for i, t in rows}
    assert {r.doc_id: r.text for r in linedup.dedup_lines(docs(spark, rows)).collect()} == want


def join_rows(spark, since: int) -> int:
    """The most rows that a join made in the executions from number ``since`` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    most, runs = 0, store.executionsList()
    for e in (runs.apply(i) for i in range(runs.size())):
        if e.executionId() < since:
            continue
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            for m in (n.metrics().apply(i) for i in range(n.metrics().size()) if "Join" in n.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_line_dedup_of_a_common_line_twice_makes_no_rows_of_pairs(spark):
    """240 different documents hold a line, half of them twice: no earlier one has the second line of those but they themselves."""
    rng = random.Random(61)
    line, own = prose(rng, 12), [prose(rng, 12) for _ in range(240)]
    rows = [(i, f"{own[i]}\n{line}" if i < 120 else f"{line}\n{own[i]}\n{line}") for i in range(240)]
    rows += [(1000 + i, own[i]) for i in range(240)]  # so that no two have the same shared lines
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.doc_id: r.n_removed_lines for r in linedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {i: (0 if i == 0 else 1 if i <= 120 else 2) if i < 240 else 1 for i, _ in ((r[0], 0) for r in rows)}
    assert 0 < join_rows(spark, since) < 10 * len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_by_outlines_equals_all_pairs(spark, seed):
    """One holder for all of an outline: what alignment of all pairs removes, with hardly any pairs tried before or one by one."""
    rng = random.Random(70 + seed)
    stock = [prose(rng, n, 60) for n in (4, 6, 10, 12, 15) for _ in range(1 + seed % 2)] + [""]
    rows = [(i, "\n".join(rng.choice(stock) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 14)) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    rows += [(300 + k, prose(rng, 14) + "\n" + rows[5 * k][1]) for k in range(10)]

    def sliced(t):
        body = b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in t.split("\n"))
        return linedup.slices(body, np.array([len(x.split()) for x in t.split("\n")], "<i4").tobytes(), 10)

    cut = {i: sliced(t) for i, t in rows}
    want = {i: sorted({y for j, _ in rows if j < i for y in linedup.common_blocks(cut[j], cut[i], 10)}) for i, t in rows}
    got = {r.id: sorted(r.removed) for r in linedup.removed_lines(docs(spark, rows), rare=1, few=(1, 3, 8, 20)[seed]).collect()}
    assert got == {i: x for i, x in want.items() if x}
