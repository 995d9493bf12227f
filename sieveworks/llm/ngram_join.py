"""N-gram Jaccard join by chosen paths.

Documents are sets of word n-grams.  Equal sets form one class first; only one representative of
each goes on.  A set is embedded as ``SKETCH`` min-wise tokens.  A run starts by splitting all sets
by a sampled token (sets that agree on it share a bucket) and splits buckets again by further
sampled tokens until they are small; small buckets are compared by brute force on sketches of
``CHECKS`` bytes.  ``limit`` is what one task compares in about a second (4096^2 / 2 pairs); it bounds the
work of a set in any bucket to 0.1 ms, a tenth of what a document may cost.
In a large bucket the members like its first member are linked to it, and only buckets
with members that aren't linked yet are split further, however many levels that takes.  Runs are repeated until a pair at
the threshold is found with probability ``recall`` at the depth its buckets were split to; a node samples 1.25 tokens on average, which at
similarity 0.8 keeps the expected number of shared children at one.

Linked sets form candidate groups.  Within each, exact Jaccard similarities of all pairs are
computed from the whole sets, in blocks of ``block`` x ``block`` for large groups, and counted where
they are found, so no pair leaves its task.  The result has one row per document: its class (smallest
id of all documents reachable by links), its copy class (smallest id with an equal set) and its
number of links (other documents with similarity of at least the threshold, copies included).

Words are runs of ASCII letters and digits and of any non-ASCII characters, in lower case.  Defined
results: a text of fewer words than n is one n-gram of all its words; a text without words and a row
with a null id have no links and are a class of their own (null id: null class); rows of one id with
different texts are separate; repeated rows are copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialize
from .components import components
from .hashing import hashed_words

#: Tokens that buckets are split by, and tokens of which a byte each is compared (the first ones are the same).
SKETCH, CHECKS = 48, 128
#: Sketch agreement that sends a pair to the exact comparison; at similarity 0.8 it is 5 standard deviations below the mean.
SLACK = 5.2
#: Levels after which a bucket of sets with different tags can only hold sets that agree in every token.
GUARD = 200
#: Tokens of the sets that are compared at once, on average.
BLOCK_TOKENS = 1 << 21
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, CHECKS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of each text."""
    h, _, text = hashed_words(texts)
    w = _mix(h[:, 0].astype(np.uint64) + np.uint64(1))
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    powers = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(n)]
    m = max(0, len(w) - n + 1)
    rolled = np.zeros(m, np.uint64)
    for k in range(n):
        rolled += w[k : k + m] * powers[k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(_mix(np.array([sum(int(w[a + k]) * int(powers[k]) for k in range(b - a)) % 2**64 ^ (b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    a, b = (int(x.sum(dtype=np.uint64)) if len(s) else 0 for x in (s, _mix(s + np.uint64(7))))
    return a - 2**64 if a >= 2**63 else a, b - 2**64 if b >= 2**63 else b


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """CHECKS min-wise tokens of non-empty sets."""
    if not sets:
        return np.zeros((0, CHECKS), np.uint32)
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(((flat * m) >> np.uint64(32)).astype(np.uint32), first) for m in _MULTIPLIERS], axis=1)


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, size, h1, h2, sketch, check): the set's size, 128-bit hash, SKETCH tokens and a byte of CHECKS tokens (none for the empty set)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], n)
                full = [i for i, s in enumerate(sets) if len(s)]
                tokens = sketches([sets[i] for i in full])
                size, check = np.zeros(len(sets) + 1, np.int32), [None] * len(sets)
                size[np.array(full, np.int64) + 1] = SKETCH
                for i, row in zip(full, tokens.astype(np.uint8)):
                    check[i] = row.tobytes()
                hashes = [set_hash(s) for s in sets]
                split = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(np.ascontiguousarray(tokens[:, :SKETCH]).view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int32()), pa.array([x for x, _ in hashes], pa.int64()), pa.array([y for _, y in hashes], pa.int64()), split, pa.array(check, pa.binary())],
                    ["id", "text_hash", "size", "h1", "h2", "sketch", "check"],
                )

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, f"id {kind}, text_hash long, size int, h1 long, h2 long, sketch array<int>, check binary")


def _groups(check: np.ndarray, agree: int) -> np.ndarray:
    """For each row the first row that it is connected to by rows that agree in at least ``agree`` bytes."""
    n = len(check)
    if n <= 64:
        like = (check[:, None, :] == check[None, :, :]).sum(-1) >= agree
    else:
        count = np.zeros((n, n), np.uint8)  # CHECKS fits a byte
        for column in np.ascontiguousarray(check.T):
            count += column[:, None] == column[None, :]
        like = count >= agree
    up = np.full(n, -1)
    for s in range(n):
        if up[s] < 0:
            up[s] = s
            todo = [s]
            while todo:
                new = np.flatnonzero(like[todo.pop()] & (up < 0))
                up[new] = s
                todo += new.tolist()
    return up


def _brute_force(small: DataFrame, agree: int) -> DataFrame:
    """(a, b): stars over the sets of each bucket that are connected by pairs whose sketches agree; small: (key, id, check)."""

    def run(batches):
        for b in batches:
            lists = b.column(0)
            flat = lists.flatten()
            ids = flat.field("id").to_numpy(zero_copy_only=False)
            check = np.frombuffer(b"".join(flat.field("check").to_pylist()), np.uint8).reshape(-1, CHECKS)
            at, tops, rest = 0, [], []
            for n in lists.value_lengths().to_pylist():
                own = ids[at : at + n]
                top = own[_groups(check[at : at + n], agree)]
                tops.append(top[top != own])
                rest.append(own[top != own])
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (tops, rest)], ["a", "b"])

    members = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "check"))).alias("members"))
    return members.select("members").mapInArrow(run, "a long, b long")


def _like_first(large: DataFrame, agree: int) -> DataFrame:
    """large with whether each set is like its bucket's first one (``pivot``); those that are take its tag."""
    columns = "key long, id long, sketch array<int>, check binary, pivot long, like boolean, tag long"

    def run(batches):
        for b in batches:
            own, first = (np.frombuffer(b"".join(b.column(b.schema.names.index(c)).to_pylist()), np.uint8).reshape(-1, CHECKS) for c in ("check", "first"))
            like = pa.array((own == first).sum(axis=1) >= agree)
            tag = pa.compute.if_else(like, b.column(b.schema.names.index("first_tag")), b.column(b.schema.names.index("tag")))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in ("key", "id", "sketch", "check", "pivot")), like, tag], ["key", "id", "sketch", "check", "pivot", "like", "tag"])

    first = large.groupBy("key").agg(F.min("id").alias("pivot"), F.min_by(F.struct("check", "tag"), "id").alias("f"))
    first = first.select("key", "pivot", F.col("f.check").alias("first"), F.col("f.tag").alias("first_tag"))
    return large.join(first, "key").mapInArrow(run, columns)


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs until a pair at the threshold meets with probability ``recall`` in buckets split ``depth`` times after the root."""
    miss = 0.0
    for _ in range(depth + 1):
        apart = 1 - threshold + threshold * miss  # by one sampled token: split now or lost further down
        miss = 0.75 * apart + 0.25 * apart**2
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def candidate_edges(reps: DataFrame, threshold: float, recall: float, limit: int, tables: list[DataFrame]) -> DataFrame:
    """(a, b): edges that connect the representatives of similar sets; reps: (id, sketch, check).

    tables gets the tables that the edges are read from.

    Sets whose buckets had to be split go through further runs, as many as the depth that was reached needs.
    """
    done = depth = 0
    sets, edges = reps.withColumn("tag", F.col("id")), None
    while (runs := runs_needed(threshold, recall, depth)) > done:
        found, deep, reached = _search(sets, range(done, runs), threshold, limit, tables)
        edges = found if edges is None else edges.union(found)
        done, depth = runs, max(depth, reached)
        if deep is None or runs_needed(threshold, recall, depth) <= done:
            break
        sets = deep
    return edges


def _search(reps: DataFrame, runs: range, threshold: float, limit: int, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame | None, int]:
    """Edges found by these runs over reps (id, sketch, check, tag), the sets of buckets that were split, and how often in a row."""

    def kept(df: DataFrame, tag: str) -> DataFrame:
        tables.append(materialize(df, tag))
        return tables[-1]

    share = threshold + (1 - threshold) / 256  # bytes of different tokens agree by chance
    agree = max(1, math.floor(CHECKS * share - SLACK * math.sqrt(CHECKS * share * (1 - share))))
    order = np.random.default_rng(5).permutation(SKETCH).tolist()
    taken, start = 0, []
    for r in range(runs.stop):
        for _ in range(2 if r % 4 == 3 else 1):
            start.append((r, order[taken % SKETCH]))
            taken += 1
    start = [x for x in start if x[0] >= runs.start]
    token = lambda j: F.element_at("sketch", j + 1)
    # tag: sets with one tag are known to be in one candidate group, a bucket with one tag has nothing to find
    nodes = reps.select("id", "tag", F.explode(F.array(*[F.xxhash64(F.lit(r), F.lit(j), token(j)) for r, j in start])).alias("key"))
    sizes = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("key", "n")
    live = kept(nodes.drop("tag").join(sizes, "key"), "live")
    # similar sets meet in most runs: equal small buckets are compared once
    small = live.where(F.col("n") <= limit).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids").distinct()
    small = small.select(F.xxhash64("ids").alias("key"), F.explode("ids").alias("id")).join(reps.select("id", "check"), "id")
    edges = kept(_brute_force(small, agree), "found")
    live = live.where(F.col("n") > limit)
    if live.isEmpty():
        return edges, None, 0
    large, deep, depth = live.join(reps, "id").select("key", "id", "sketch", "check", "tag"), None, 0
    while True:
        judged = kept(_like_first(large, agree), "judged")
        edges = edges.union(judged.where("like AND id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        if depth == 0:
            # what all runs have linked so far counts in every bucket: a group of near copies is known by now
            label = components(edges).select("id", "label")
            judged = judged.join(label, "id", "left").withColumn("tag", F.coalesce("label", "tag")).drop("label")
            open_ = judged.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("key")
            judged = kept(judged.join(open_, "key"), "judged")
            deep = judged.groupBy("id").agg(F.first("sketch").alias("sketch"), F.first("check").alias("check"), F.first("tag").alias("tag"))
        if depth == GUARD:  # only sets that agree in every token come here: they are one candidate group
            lowest = judged.groupBy("key").agg(F.min("id").alias("a"))
            return edges.union(judged.join(lowest, "key").where("id <> a").select("a", F.col("id").alias("b"))), deep, depth
        pick = lambda salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(SKETCH)).cast("int") + 1
        child = lambda salt: F.xxhash64("key", pick(salt), F.element_at("sketch", pick(salt)))
        second = F.when(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(4)) == 0, child(2))
        keys = F.array_distinct(F.array_compact(F.array(child(1), second)))
        nodes = judged.select(F.explode(keys).alias("key"), "id", "sketch", "check", "tag")
        sizes = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("key", "n")
        live = kept(nodes.join(sizes, "key"), "live")
        if live.isEmpty():
            return edges, deep, depth
        depth += 1
        edges = edges.union(kept(_brute_force(live.where(F.col("n") <= limit), agree), "found"))
        large = live.where(F.col("n") > limit).drop("n")
        if large.isEmpty():
            return edges, deep, depth


def _count_links(sets: list[np.ndarray], sides: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs with similarity of at least ``threshold``: within the members if all sides are 0, else across the two sides."""
    size = np.array([len(s) for s in sets])
    token = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    new = np.diff(token, prepend=token[:1] ^ np.uint64(1)) != 0
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # tokens of one member can't be common
    number, who = number[shared], who[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    if len(number):
        number = np.cumsum(np.diff(number, prepend=number[0]) != 0)
        for lo in range(0, int(number[-1]) + 1, 2048):
            a, b = np.searchsorted(number, [lo, lo + 2048])
            part = np.zeros((2048, len(sets)), np.float32)
            part[number[a:b] - lo, who[a:b]] = 1
            common += part.T @ part
    links = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(links, False)
    if sides.any():
        links &= sides[:, None] != sides[None, :]
    return links


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 1 - 1e-6, limit: int = 4096, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, copy_id, n_links, stays, text_hash) of every row.

    stays: whether the row is its class's one document, the smallest id's (of one id's, the smallest set hash), or has no links;
    equal rows are alike in that, too.  text_hash: xxhash64 of the text, for joining with rows that share an id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sig = materialize(signatures(docs, n, id_col, text_col), "signatures")
    known = sig.where("id IS NOT NULL AND size > 0")
    reps = materialize(known.groupBy("h1", "h2").agg(F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("check").alias("check")), "reps")
    # two different sets may have the same smallest id only when rows share ids; a number of their own keeps them apart
    sets_of, reps = reps, reps.withColumn("id", F.xxhash64("h1", "h2"))
    tables: list[DataFrame] = []
    group = components(candidate_edges(reps.select("id", "sketch", "check"), threshold, recall, limit, tables)).withColumnRenamed("label", "grp")
    discard(tables)
    members = group.join(reps.select("id", "h1", "h2", "copy_id", "copies", "size"), "id")
    size = members.groupBy("grp").agg(F.count("*").alias("members"), F.sum(F.col("size").cast("long")).alias("tokens"))
    width = F.ceil(F.greatest(F.col("members") / block, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    # blocks by salted hash, so that a group with a third of all rows is never ranked in one task
    members = members.join(size, "grp").withColumn("blocks", width).withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int"))
    members = materialize(members.select("grp", "id", "h1", "h2", "copy_id", "copies", "blocks", "block"), "members")
    # the whole sets of the candidates, from their texts; only one row of each set is needed
    # the candidates grow with the documents, so this join is always a merge of two shuffled sides
    source = docs.select(F.col(id_col).alias("copy_id"), F.col(text_col).alias("text")).join(members.hint("merge"), "copy_id")

    def to_sets(batches):
        names = ["id", "grp", "block", "blocks", "copies", "tokens"]
        for b in batches:
            cols = {k: b.column(b.schema.names.index(k)).to_pylist() for k in ("id", "grp", "block", "blocks", "copies", "h1", "h2", "text")}
            for lo, hi in chunks(cols["text"]):
                sets = shingle_sets(cols["text"][lo:hi], n)
                keep = [i for i, s in enumerate(sets, lo) if set_hash(s) == (cols["h1"][i], cols["h2"][i])]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.array([cols[k][i] for i in keep], t) for k, t in zip(names, kinds)), pa.array([sets[i - lo].tobytes() for i in keep], pa.binary())], names)

    sets = source.select("id", "grp", "block", "blocks", "copies", "h1", "h2", "text").mapInArrow(to_sets, "id long, grp long, block int, blocks int, copies long, tokens binary")
    sets = sets.dropDuplicates(["id"])
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    placed = sets.withColumn("other", other).select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "tokens")

    def verify(batches):
        for b in batches:
            out = {"id": [], "other": [], "links": []}
            for members, i, j in zip(*(c.to_pylist() for c in b.columns)):
                ids = [m["id"] for m in members]
                links = _count_links([np.frombuffer(m["tokens"], np.uint64) for m in members], np.array([m["block"] != i for m in members]), threshold)
                weight = links @ np.array([m["copies"] for m in members], np.int64)
                out["id"] += ids
                out["links"] += weight.tolist()
                up = np.arange(len(ids))
                seen = np.zeros(len(ids), bool)
                for s in range(len(ids)):
                    if not seen[s]:
                        seen[s] = True
                        todo = [s]
                        while todo:
                            new = np.flatnonzero(links[todo.pop()] & ~seen)
                            seen[new] = True
                            up[new] = s
                            todo += new.tolist()
                out["other"] += [ids[k] for k in up]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())]))

    blocks = placed.groupBy("grp", "i", "j").agg(F.collect_list(F.struct("id", "block", "copies", "tokens")).alias("members"))
    checked = materialize(blocks.select("members", "i", "j").mapInArrow(verify, "id long, other long, links long"), "checked", tidy=True)
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(checked.where("links > 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    # the class takes the smallest document id of its members
    named = label.join(reps.select("id", "copy_id"), "id")
    smallest = named.groupBy("label").agg(F.min(F.struct("copy_id", "id")).alias("first"))
    named = named.join(smallest, "label").select("id", F.col("first.copy_id").alias("class_id"), (F.col("first.id") == F.col("id")).alias("leads")).join(links, "id", "left")
    per_set = reps.join(named, "id", "left").select("h1", "h2", F.col("copy_id").alias("_copy"), F.coalesce("leads", F.lit(True)).alias("_leads"), F.coalesce("class_id", "copy_id").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    out = sig.select("id", "text_hash", "size", "h1", "h2").join(per_set, ["h1", "h2"], "left")
    alone = F.col("id").isNull() | (F.col("size") == 0)
    out = out.select(
        F.col("id").cast(kind).alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("_class")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("_copy")).alias("copy_id"),
        F.when(alone, 0).otherwise(F.col("_links")).cast("long").alias("n_links"),
        (alone | (F.col("_leads") & (F.col("id") == F.col("_copy")))).alias("stays"),
        "text_hash",
    )
    out = materialize(out, "classes")
    discard([sig, sets_of, members, checked])
    return out
