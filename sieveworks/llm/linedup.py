"""Line dedup by pairwise alignment.

Documents that share a run of lines of at least ``min_block_words`` words overlap.  Shared runs are
found by the shortest runs from and up to each line, which every block of that size is made of,
whatever the length of its lines.  Overlapping documents are aligned by patience diff on all lines, short
and blank ones too, that lie in runs of at least
``min_block_words`` words which both hold: common head and tail, lines unique in both, the longest
increasing run of those, and the same again in the gaps.  Aligned lines that follow each other in
both documents form a block, with the blank lines at its edges; blocks of at least
``min_block_words`` words are deleted from the later document.

The result is that of aligning all pairs of overlapping documents.  An alignment reads of a document only
the lines in runs that it shares with any other (its core), so documents with equal cores form a class:
all but the first lose their core whole, and only classes are compared.  Each is aligned with the first
``rare`` holders of each of its runs (smallest ids).  If that leaves lines of a run with more holders,
the class is aligned with the others as well; otherwise they could not add anything.  Runs that more than
``few`` of an open run's holders hold are that run's common company.  Holders that share another run with
the class are aligned one by one, at most ``few`` for each.  With the rest it shares common company only, so
of those with the same outline (their lines in it, gaps and order) one stands for all.

Defined results: lines are compared without surrounding blanks; null text has no lines and stays
null; rows with a null id stay as they are; rows of one id are not compared with each other; equal
rows get equal results; rows pass one to one and other columns stay as they are, whatever their names;
columns named like the counts that are asked for give way to them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Documents whose texts a Python task holds at once, beside the batch they came in.
PACK_ROWS = 256


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al >= ah or bl >= bh:
            continue
        at: dict = {}
        for i in range(al, ah):
            at[a[i]] = -1 if a[i] in at else i
        seen: dict = {}
        for j in range(bl, bh):
            seen[b[j]] = -1 if b[j] in seen else j
        both = [(at[x], j) for x, j in seen.items() if j >= 0 and at.get(x, -1) >= 0]
        if not both:
            continue
        both.sort(key=lambda p: p[1])
        tops, piles, link = [], [], []
        for n, (i, _) in enumerate(both):
            k = bisect_left(tops, i)
            link.append(piles[k - 1] if k else -1)
            if k == len(tops):
                tops.append(i)
                piles.append(n)
            else:
                tops[k], piles[k] = i, n
        n, run = piles[-1], []
        while n >= 0:
            run.append(both[n])
            n = link[n]
        edge_a, edge_b = al, bl
        for i, j in reversed(run):
            todo.append((edge_a, i, edge_b, j))
            out.append((i, j))
            edge_a, edge_b = i + 1, j + 1
        todo.append((edge_a, ah, edge_b, bh))
    return sorted(out)


def runs(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs of lines with at least ``min_words`` words, one from and one up to each line with words."""
    out, upto = set(), [0, *accumulate(words)]
    for at, n in enumerate(words):
        if n:
            end = bisect_left(upto, upto[at] + min_words, at + 1)
            if end < len(upto):
                out.add((at, end))
            start = bisect_right(upto, upto[at + 1] - min_words) - 1
            if start >= 0:
                out.add((start, at + 1))
    return out


def slices(body: bytes, words: bytes, min_words: int) -> tuple[list[int], list[int], dict[bytes, list[tuple[int, int]]]]:
    """A document's line hashes, words per line, and its runs by content; body and words are packed numbers."""
    n = np.frombuffer(words, "<i4").tolist()
    by: dict[bytes, list[tuple[int, int]]] = {}
    for start, end in runs(n, min_words):
        by.setdefault(body[8 * start : 8 * end], []).append((start, end))
    return np.frombuffer(body, "<i8").tolist(), n, by


def common_blocks(a: tuple, b: tuple, min_words: int, only: set[int] | None = None) -> list[int]:
    """Line numbers of b in aligned blocks of at least ``min_words`` words; a, b: documents as ``slices`` has them.

    only: the digests of the runs that count, as if no other were shared.
    """
    (a_lines, a_words, a_runs), (b_lines, b_words, b_runs) = a, b
    common = a_runs.keys() & b_runs.keys()
    if only is not None:
        common = {k for k in common if digest(k) in only}
    # a block of min_words words is made of runs that both documents hold, so lines outside those are not aligned
    a_at, b_at = (sorted({x for k in common for lo, hi in by[k] for x in range(lo, hi)}) for by in (a_runs, b_runs))
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for m, n in [*patience([a_lines[i] for i in a_at], [b_lines[j] for j in b_at]), (None, None)]:
        pair = None if m is None else (a_at[m], b_at[n])
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(b_words[j] for _, j in block) >= min_words:
                (i, j), (k, l) = block[0], block[-1]
                while i and j and a_lines[i - 1] == b_lines[j - 1] and not b_words[j - 1]:  # blank lines at its edges belong to it
                    i, j = i - 1, j - 1
                while k + 1 < len(a_lines) and l + 1 < len(b_lines) and a_lines[k + 1] == b_lines[l + 1] and not b_words[l + 1]:
                    k, l = k + 1, l + 1
                out += range(j, l + 1)
            block = []
        if pair:
            block.append(pair)
    return sorted(set(out))


def digest(x: bytes) -> int:
    return int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True)


def edges(words: list[int], start: int, end: int) -> tuple[int, int]:
    """The stretch with the blank lines at its edges."""
    while start and not words[start - 1]:
        start -= 1
    while end < len(words) and not words[end]:
        end += 1
    return start, end


def covered(words: list[int], by: dict[bytes, list[tuple[int, int]]], keys: set[int]) -> list[int]:
    """Line numbers in runs of these keys, blank lines at their edges included."""
    return sorted({x for k, places in by.items() if digest(k) in keys for lo, hi in places for x in range(*edges(words, lo, hi))})


def outline(body: bytes, words: bytes, keys: set[int], min_words: int) -> bytes:
    """What an alignment over these keys alone reads of a document, hashed: the lines they cover and where others lie between."""
    _, n, by = slices(body, words, min_words)
    at = covered(n, by, keys)
    return blake2b(b"".join((b"-" if i and p != at[i - 1] + 1 else b"+") + body[8 * p : 8 * p + 8] for i, p in enumerate(at)), digest_size=16).digest()


def core(body: bytes, words: bytes, shared: set[int], min_words: int) -> tuple[bytes, list[int], bytes, bytes]:
    """(class, line numbers, body, words) of a document's lines in shared runs, blank lines at their edges included.

    Alignments read nothing else of a document.  What lies between is one line, number -1, that no other class has.
    """
    _, n, by = slices(body, words, min_words)
    at = covered(n, by, shared)
    lines = [x for i, p in enumerate(at) for x in ([-1, p] if i and p != at[i - 1] + 1 else [p])]
    name = blake2b(b"".join(body[8 * p : 8 * p + 8] if p >= 0 else bytes(8) for p in lines), digest_size=16).digest()
    own = b"".join(body[8 * p : 8 * p + 8] if p >= 0 else blake2b(name + i.to_bytes(4), digest_size=8).digest() for i, p in enumerate(lines))
    return name, lines, own, np.array([n[p] if p >= 0 else min_words for p in lines], "<i4").tobytes()


def open_keys(body: bytes, words: bytes, keys: set[int], gone: list[int], min_words: int) -> list[int]:
    """Those of the keys whose runs, with the blank lines at their edges, still have lines that are not gone."""
    _, n, by = slices(body, words, min_words)
    lost = set(gone)
    return [d for d, places in ((digest(k), v) for k, v in by.items()) if d in keys and any(x not in lost for lo, hi in places for x in range(*edges(n, lo, hi)))]


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = 10, rare: int = 4, few: int = 64) -> DataFrame:
    """(id, _text, removed array<int>): line numbers to delete from the row with that id and text hash; only rows that lose lines."""
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        for b in (whole.slice(i, PACK_ROWS) for whole in batches for i in range(0, whole.num_rows, PACK_ROWS)):
            bodies, words, keys = [], [], []
            for t in b.column(2).to_pylist():
                lines = [x.replace("\r", "").strip(" ") for x in t.split("\n")]
                bodies.append(b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in lines))
                words.append(np.array([len(x.split(" ")) - x.split(" ").count("") for x in lines], "<i4").tobytes())
                keys.append([digest(k) for k in slices(bodies[-1], words[-1], min_block_words)[2]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bodies, pa.binary()), pa.array(words, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "_text", "body", "words", "keys"])

    def cut(batches):
        for b in batches:
            ids, texts, body, words, keys = b.columns
            out = [core(x, n, set(k), min_block_words) for x, n, k in zip(body.to_pylist(), words.to_pylist(), keys.to_pylist())]
            name, at, own, n = zip(*out) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array(name, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(own, pa.binary()), pa.array(n, pa.binary()), keys], ["id", "_text", "class", "at", "body", "words", "keys"])

    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("text"))
    bodies = known.mapInArrow(pack, f"id {kind}, _text long, body binary, words binary, keys array<long>")
    bodies = materialize(bodies.dropDuplicates(["id", "_text"]), "bodies")
    keys = bodies.select("id", "_text", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key")
    held = keys.join(shared, "key").groupBy("id", "_text").agg(F.collect_list("key").alias("keys"))
    cores = bodies.select("id", "_text", "body", "words").join(held, ["id", "_text"])
    cores = materialize(cores.mapInArrow(cut, f"id {kind}, _text long, class binary, at array<int>, body binary, words binary, keys array<long>"), "cores")
    # equal cores align alike with any other, so classes are compared, in the order of their first documents
    classes = cores.groupBy("class").agg(F.min("id").alias("first"), F.first(F.struct("body", "words", "keys")).alias("c"))
    classes = materialize(classes.select("class", "first", "c.*"), "classes")
    holders = materialize(classes.select("class", "first", F.explode("keys").alias("key")), "holders")
    # each task passes on the first holders of a key only, so a common key costs a few rows a task
    place = F.row_number().over(Window.partitionBy("key").orderBy("first", "class"))
    early = materialize(holders.select("key", F.col("class").alias("other"), F.col("first").alias("before"), place.alias("place")).where(F.col("place") <= rare + 1), "early")

    def align(batches):
        seen, other = None, None
        for b in batches:
            name, body, words, earlier, only = b.columns
            out = []
            for own, n, e, o in zip(body.to_pylist(), words.to_pylist(), earlier.to_pylist(), only.to_pylist()):
                if e != seen:  # one earlier class's pairs follow each other
                    seen, other = e, slices(e["body"], e["words"], min_block_words)
                out.append(common_blocks(other, slices(own, n, min_block_words), min_block_words, None if o is None else set(o)))
            yield pa.RecordBatch.from_arrays([name, pa.array(out, pa.list_(pa.int32()))], ["class", "gone"])

    def aligned(pairs: DataFrame) -> DataFrame:
        """(class, line): what the pairs (class, other, only) align, as places in the class's core; only: the keys that count, null for all."""
        earlier = classes.select(F.col("class").alias("other"), F.struct("body", "words").alias("earlier"))
        both = pairs.join(classes.select("class", "body", "words"), "class").join(earlier, "other")
        found = both.select("class", "body", "words", "earlier", "only").mapInArrow(align, "class binary, gone array<int>")
        return found.select("class", F.explode("gone").alias("line")).distinct()

    def still_open(batches):
        for b in batches:
            name, first, body, words, keys, gone = b.columns
            out = [open_keys(x, n, set(k), g or [], min_block_words) for x, n, k, g in zip(body.to_pylist(), words.to_pylist(), keys.to_pylist(), gone.to_pylist())]
            yield pa.RecordBatch.from_arrays([name, first, pa.array(out, pa.list_(pa.int64()))], ["class", "first", "keys"])

    def drawn(batches):
        for b in batches:
            key, name, first, company, body, words = b.columns
            out = [outline(x, n, set(k), min_block_words) for x, n, k in zip(body.to_pylist(), words.to_pylist(), company.to_pylist())]
            yield pa.RecordBatch.from_arrays([key, name, first, company, pa.array(out, pa.binary())], ["key", "class", "first", "company", "outline"])

    every = F.lit(None).cast("array<long>").alias("only")
    tried = materialize(holders.join(early.where(F.col("place") <= rare), "key").where("before < first").select("class", "other").distinct(), "tried")
    gone = materialize(aligned(tried.select("*", every)), "gone")
    # the further holders of a common run are compared as well, unless the first ones leave nothing of it
    more = holders.join(early.where(F.col("place") > rare).select("key", "before"), "key").where("before < first").groupBy("class").agg(F.collect_list("key").alias("common"))
    lost = gone.groupBy("class").agg(F.collect_list("line").alias("lost"))
    left = classes.join(more, "class").join(lost, "class", "left").select("class", "first", "body", "words", "common", "lost")
    left = left.mapInArrow(still_open, f"class binary, first {kind}, keys array<long>").select("class", "first", F.explode("keys").alias("key"))
    left = materialize(left, "left")
    # the holders of the open keys, each with all its keys; (key, mate) is common if more than few of them have both
    mates = holders.join(left.select("key").distinct(), "key").join(classes.select("class", F.explode("keys").alias("mate")), "class")
    mates = materialize(mates.select("key", "mate", "class", "first"), "mates")
    common = materialize(mates.groupBy("key", "mate").count().where(F.col("count") > few).select("key", "mate"), "common")
    scarce = mates.join(common, ["key", "mate"], "left_anti")
    mine = left.join(scarce.select("key", "mate", "class"), ["key", "class"])
    near = mine.join(scarce.select("key", "mate", F.col("class").alias("other"), F.col("first").alias("before")), ["key", "mate"])
    near = materialize(near.where("before < first").select("class", "key", "other").distinct(), "near")
    # with its other holders a class shares common keys only, and those with the same outline of them align alike
    company = mates.join(common, ["key", "mate"]).groupBy("key", "class", "first").agg(F.collect_list("mate").alias("company"))
    outlines = company.join(classes.select("class", "body", "words"), "class").select("key", "class", "first", "company", "body", "words")
    outlines = materialize(outlines.mapInArrow(drawn, f"key long, class binary, first {kind}, company array<long>, outline binary"), "outlines")
    met = near.join(outlines.select("key", F.col("class").alias("other"), "outline"), ["key", "other"]).groupBy("class", "key", "outline").agg(F.count("*").alias("n"))
    met = materialize(met, "met")
    most = met.agg(F.max("n")).first()[0] or 0
    # of n holders met already one more is earlier than the class if and only if holder n + 1 is
    turn = F.row_number().over(Window.partitionBy("key", "outline").orderBy("first", "class"))
    seats = outlines.select("key", "outline", F.col("class").alias("other"), F.col("first").alias("before"), turn.alias("turn")).where(F.col("turn") <= most + 1)
    seats = materialize(seats, "seats")
    far = left.join(outlines.select("key", "class", "company"), ["key", "class"]).join(seats.where("turn = 1").select("key", "outline", "other"), "key")
    far = far.join(met, ["class", "key", "outline"], "left").withColumn("turn", F.coalesce("n", F.lit(0)) + 1)
    far = far.join(seats.select("key", "outline", "turn", "before"), ["key", "outline", "turn"]).where("before < first")
    further = near.select("class", "other").distinct().join(tried, ["class", "other"], "left_anti").select("*", every)
    further = further.union(far.select("class", "other", F.col("company").alias("only")))
    gone_all = gone.union(aligned(further)).distinct().groupBy("class").agg(F.collect_list("line").alias("gone"))
    # a later document of a class shares its whole core with the first
    rows = cores.select("id", "_text", "class", "at").join(classes.select("class", "first"), "class").join(gone_all, "class", "left")
    lines = F.when(F.col("id") > F.col("first"), F.filter("at", lambda x: x >= 0)).otherwise(F.transform("gone", lambda i: F.get("at", i)))
    out = materialize(rows.select("id", "_text", lines.alias("removed")).where("size(removed) > 0"), "removed", tidy=True)
    discard([bodies, cores, classes, holders, early, tried, gone, left, mates, common, near, outlines, met, seats])
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = 10, counts: bool = True) -> DataFrame:
    """docs with the lines deleted from ``text_col``; with ``counts`` also their number in ``n_removed_lines`` beside ``n_lines``."""
    gone = removed_lines(docs, id_col, text_col, min_block_words).select(F.struct("id", "_text").alias("key"), "removed")
    # input columns stay in a struct, so that no name can clash
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("_text")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(gone, "key", "left")
    text, cut = F.col("row")[text_col], F.col("removed").isNotNull()
    lines = F.split(text, "\n")
    kept = F.when(cut, F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")).otherwise(text)
    numbers = [F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.when(cut, F.size("removed")).otherwise(0).alias("n_removed_lines")] if counts else []
    own = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed_lines"))]
    return joined.select(*[(kept if c == text_col else F.col("row")[c]).alias(c) for c in own], *numbers)
