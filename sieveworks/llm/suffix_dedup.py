"""Suffix-array dedup: remove bytes covered by strings of ``length`` bytes that also start in an earlier document.

All equal windows of ``length`` bytes share their minimizer (the smallest hashed k-gram inside), so a
text is cut into stretches of neighbouring windows with one minimizer, and only stretches with equal
minimizers can have windows in common.  Equal stretches need no search: all holders but the smallest
id lose them.  Stretches count as equal by 96 hash bits (36 of the minimizer, 60 of the content); among
the 6 10^12 stretches of 100 TB that makes 2 10^-4 wrong pairs in all.  Different stretches of one
minimizer go to a Burrows-Wheeler transform, made from their suffix array.  Breadth-first backward
extension on the transform splits the intervals of common prefixes for increasing prefix lengths, and
stops at ``length``: what is then still together shares at least so many bytes, and every window outside
its interval's smallest document is removed.

The first pass shuffles 14 bytes per stretch, about every sixteenth byte of text; of equal stretches in
one block of text only the smallest holder's is compared, so a stretch that a third of all documents hold
comes once per block.  A minimizer with more than ``hot`` different stretches is no single group: its
stretches are cut into parts of ``PART`` windows by their distance to the minimizer, and parts are grouped
by all the bytes that their windows must share.

Defined results: null text is empty; windows never cross documents; rows of one id do not remove
each other's bytes and are cut each by its own text; a row with a null id stays whole and removes nothing; repeated rows pass one to
one; an empty table gives no rows; other columns may have any names, with ``as_text`` they all stay.  Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, shuffle_width

K = 20
_POS = 28  # bits of a position within a chunk
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLES: dict[str, np.ndarray] = {}
REMOVE, SEARCH, PARTS = 0, 1, 2
#: Windows in a part of a hot minimizer's stretch.
PART = 8
#: Bytes of text whose windows are worked on at once; longer texts are cut between windows.
SEGMENT = 1 << 23


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("power", ())) < n:
        n = max(n, 1 << 22)
        for name, b in (("power", _BASE), ("inverse", pow(_BASE, -1, 2**64))):
            step = np.full(n, b, np.uint64)
            step[0] = 1
            _TABLES[name] = np.multiply.accumulate(step)
    return _TABLES["power"], _TABLES["inverse"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(raws: list[bytes], length: int, k: int = K):
    """(text number, first window, last window, place of the minimizer, minimizer, content) of every stretch; places in the text.

    minimizer: 36-bit hash; content: 64-bit hash of the bytes that the stretch's windows cover.
    """
    if len(raws) == 1 and len(raws[0]) > SEGMENT + length:
        found = [(lo, stretches([raws[0][lo : lo + SEGMENT + length - 1]], length, k)) for lo in range(0, len(raws[0]) - length + 1, SEGMENT)]
        text, a, b, place, minimizer, content = (np.concatenate(x) for x in zip(*(f for _, f in found)))
        shift = np.repeat([lo for lo, _ in found], [len(f[0]) for _, f in found])
        return text, a + shift, b + shift, place + shift, minimizer, content
    size = np.array([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    one = _BYTE[data]
    grams, n, left = None, 1, k
    h, used = one, 0
    while left:  # k-gram hashes by doubling
        if left & 1:
            if grams is None:
                grams = h
            else:
                m = len(data) - used - n + 1
                grams = grams[:m] * np.uint64(pow(_BASE, n, 2**64)) + h[used : used + m]
            used += n
        left >>= 1
        if left:
            h = h[:-n] * np.uint64(pow(_BASE, n, 2**64)) + h[n:]
            n *= 2
    least = (_mix(grams) >> np.uint64(_POS)) << np.uint64(_POS) | np.arange(len(grams), dtype=np.uint64)
    w, n = length - k + 1, 1
    while n * 2 <= w:  # minimum of each window's k-grams, the leftmost first
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    least = np.minimum(least[: len(least) - (w - n)], least[w - n :])
    end = np.cumsum(size)
    begin = end - size
    windows = np.maximum(0, size - length + 1)
    text = np.repeat(np.arange(len(raws)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    own = least[begin[text] + at]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    text, a, b = text[first], at[first], at[last]
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * power[: len(data)], dtype=np.uint64)])
    lo, hi = begin[text] + a, begin[text] + b + length
    content = _mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    place = (own[first] & np.uint64((1 << _POS) - 1)).astype(np.int64) - begin[text]
    return text, a, b, place, own[first] >> np.uint64(_POS), content


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a text of symbols below 512 in their order; a shorter suffix comes first.

    Suffixes are sorted by seven packed symbols, then those that are still tied by the ranks behind what is sorted, which doubles it.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key[: n - j] |= text[j:]
    order = np.argsort(key, kind="stable")
    slot, ordered, done = np.arange(n), key[order], 7
    rank = np.empty(n, np.int64)
    while True:
        # order[slot] is sorted by ordered; ranks are the first slots of what is equal
        new = np.ones(len(slot), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        rank[order[slot]] = np.repeat(slot[first], np.diff(np.append(first, len(slot))))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slot = slot[tied]
        if not len(slot):
            return order
        at = order[slot]
        behind = np.where(at + done < n, rank[np.minimum(at + done, n - 1)], -1)
        ordered = rank[at] * (n + 1) + behind + 1
        by = np.argsort(ordered, kind="stable")
        order[slot], ordered, done = at[by], ordered[by], 2 * done


def repeated_windows(strings: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string number, offset) of every window of ``length`` bytes that also occurs in a string of a smaller owner."""
    size = np.array([len(s) + 1 for s in strings])
    text = np.zeros(int(size.sum()), np.int64)
    end = np.cumsum(size)
    inside = np.ones(len(text), bool)
    inside[end - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    n = len(text)
    order = suffix_array(text)
    before = text[order - 1]  # the transform; the first suffix is preceded by the last separator
    follow = np.argsort(before.astype(np.uint16), kind="stable")  # where each suffix without its first symbol stands
    start = text[order]
    edge = np.ones(n, bool)  # a new interval of common prefixes begins here
    edge[1:] = (start[1:] != start[:-1]) | (start[1:] == 0)
    open_ = np.flatnonzero(~edge)
    for _ in range(1, length):
        if not len(open_):
            break
        interval = np.cumsum(edge, dtype=np.int32)
        # backward extension of all intervals by every symbol before them: neighbours part if what follows them did
        parted = interval[follow[open_]] != interval[follow[open_ - 1]]
        edge[open_[parted]] = True
        open_ = open_[~parted]
    number = np.repeat(np.arange(len(strings)), size)
    begin = np.flatnonzero(edge)
    doc = owner[number[order]]
    smallest = np.minimum.reduceat(doc, begin)
    late = doc > np.repeat(smallest, np.diff(np.append(begin, n)))
    at = np.sort(order[late])
    return number[at], at - (end - size)[number[at]]


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs; touching intervals join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_HEAD = np.dtype([("min", "<u8"), ("more", "<u4"), ("doc", "<u2")])  # 36 bits of minimizer and 28 of content; 32 more; number of the document
_VERDICT = np.dtype([("min", "<u8"), ("more", "<u4"), ("act", "u1")])


def _planes(head: np.ndarray) -> bytes:
    """Byte by byte over all rows: keys are in order, so that their leading bytes hardly change and compress well."""
    return np.ascontiguousarray(head.view(np.uint8).reshape(-1, _HEAD.itemsize).T).tobytes()


def _heads(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(_HEAD.itemsize, -1).T).view(_HEAD).ravel()


def _keys(minimizer: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return minimizer << np.uint64(28) | content >> np.uint64(36), (content & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _announce(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, local, ids, heads): the stretches of some documents, by minimizer; ids and heads are packed arrays.

    local rows hold stretches that a smaller id of the same block has too; they are settled and wait only to be told.
    """

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts, 1 << 20):
                for lo2 in range(lo, hi, 60000):
                    raws = [_raw(t) for t in texts[lo2 : min(hi, lo2 + 60000)]]
                    text, _, _, _, minimizer, content = stretches(raws, length)
                    if not len(text):
                        continue
                    key, more = _keys(minimizer, content)
                    own = ids[lo2 + text]
                    order = np.lexsort((own, more, key))
                    key, more, text, own = key[order], more[order], text[order], own[order]
                    equal = np.ones(len(key), bool)
                    equal[0] = False
                    equal[1:] = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
                    new = ~equal  # a document's repeated stretch once
                    new[1:] |= own[1:] != own[:-1]
                    first = np.maximum.accumulate(np.where(equal, 0, np.arange(len(key))))
                    head = np.empty(len(key), _HEAD)
                    head["min"], head["more"], head["doc"] = key, more, text
                    late = own > own[first]
                    rows = []
                    for local, chosen in ((False, new & ~late), (True, new & late)):
                        part = head[chosen]
                        # settled ones may go anywhere: all to one place per block
                        bucket = np.full(len(part), int(key[0] % np.uint64(buckets))) if local else ((part["min"] >> np.uint64(28)) * np.uint64(buckets) >> np.uint64(36)).astype(np.int64)
                        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                        for x, y in zip(cuts, np.append(cuts[1:], len(bucket))):
                            used, number = np.unique(part["doc"][x:y], return_inverse=True)
                            some = part[x:y].copy()
                            some["doc"] = number
                            rows.append((int(bucket[x]), local, ids[lo2 + used].astype("<i8").tobytes(), _planes(some)))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["bucket", "local", "ids", "heads"])

    return docs.mapInArrow(run, "bucket int, local boolean, ids binary, heads binary")


def _verdicts(announced: DataFrame, hot: int, width: int) -> DataFrame:
    """(id, verdict): per document the stretches that others have too, as packed rows of key, more, and REMOVE, SEARCH or PARTS."""

    def by_document(ids, key, more, act):
        out = np.empty(len(ids), _VERDICT)
        out["min"], out["more"], out["act"] = key, more, act
        order = np.argsort(ids, kind="stable")
        ids, out = ids[order], out[order]
        cuts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else np.zeros(0, np.int64)
        raw, n = out.tobytes(), _VERDICT.itemsize
        return pa.RecordBatch.from_arrays([pa.array(ids[cuts]), pa.array([raw[n * a : n * b] for a, b in zip(cuts, np.append(cuts[1:], len(ids)))], pa.binary())], ["id", "verdict"])

    def judge(parts):
        heads = [_heads(h) for _, h in parts]
        ids = np.concatenate([np.frombuffer(i, "<i8")[h["doc"]] for (i, _), h in zip(parts, heads)])
        head = np.concatenate(heads)
        order = np.lexsort((ids, head["more"], head["min"]))
        ids, key, more = ids[order], head["min"][order], head["more"][order]
        group = key >> np.uint64(28)
        new_group = np.diff(group, prepend=group[:1] ^ np.uint64(1)) != 0
        new_content = new_group.copy()
        new_content[1:] |= (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        g = np.cumsum(new_group) - 1
        first = np.maximum.accumulate(np.where(new_content, np.arange(len(ids)), 0))
        contents = np.bincount(g[new_content])[g]
        lowest = np.minimum.reduceat(ids, np.flatnonzero(new_group))[g]
        highest = np.maximum.reduceat(ids, np.flatnonzero(new_group))[g]
        act = np.where(ids > ids[first], REMOVE, np.where(contents > hot, PARTS, SEARCH))
        # a smallest holder matters only if another document has a different stretch of this minimizer
        told = (act == REMOVE) | ((contents > 1) & (lowest < highest))
        return by_document(ids[told], key[told], more[told], act[told])

    def run(batches):
        bucket, parts = None, []
        for b in batches:
            for k, local, ids, heads in zip(*(c.to_pylist() for c in b.columns)):
                if local:
                    head = _heads(heads)
                    yield by_document(np.frombuffer(ids, "<i8")[head["doc"]], head["min"], head["more"], REMOVE)
                    continue
                if parts and k != bucket:
                    yield judge(parts)
                    parts = []
                bucket = k
                parts.append((ids, heads))
        if parts:
            yield judge(parts)

    return announced.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "id long, verdict binary")


def _apply(told: DataFrame, length: int) -> DataFrame:
    """(id, hash, act, minimizer, start, bytes): REMOVE rows hold packed byte ranges, SEARCH rows a stretch or a part with the hash that it is grouped by."""
    names = ["id", "hash", "act", "minimizer", "start", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for b in batches:
            ids, hashes, texts, verdicts = (c.to_pylist() for c in b.columns)
            for lo, hi in chunks(texts, 1 << 20):
                raws = [_raw(t) for t in texts[lo:hi]]
                text, a, z, place, minimizer, content = stretches(raws, length)
                key, more = _keys(minimizer, content)
                cut = np.searchsorted(text, np.arange(len(raws) + 1))
                rows = []
                for i in range(len(raws)):
                    v = np.frombuffer(b"".join(verdicts[lo + i]), _VERDICT)
                    s = slice(cut[i], cut[i + 1])
                    me = ids[lo + i], hashes[lo + i]
                    both = v["min"] * np.uint64(0x9E3779B97F4A7C15) + v["more"]
                    mine = key[s] * np.uint64(0x9E3779B97F4A7C15) + more[s]
                    by = np.argsort(both)
                    spot = np.minimum(np.searchsorted(both[by], mine), len(v) - 1)
                    act = np.where(both[by][spot] == mine, v["act"][by][spot], 255)
                    lost = act == REMOVE
                    if lost.any():
                        p, q = runs(a[s][lost], z[s][lost] + length)
                        rows.append((*me, REMOVE, 0, 0, np.stack([p, q], 1).astype("<i8").tobytes()))
                    for j in np.flatnonzero(act == SEARCH):
                        x, y = int(a[s][j]), int(z[s][j])
                        rows.append((*me, SEARCH, int(minimizer[s][j]), x, raws[i][x : y + length]))
                    for j in np.flatnonzero(act == PARTS):
                        x, y, p = int(a[s][j]), int(z[s][j]), int(place[s][j])
                        for q in range((p - y) // PART, (p - x) // PART + 1):  # windows that start q * PART to q * PART + PART - 1 bytes before the minimizer
                            lo_x, hi_x = max(x, p - q * PART - PART + 1), min(y, p - q * PART)
                            shared = raws[i][p - q * PART : p - q * PART - PART + 1 + length]
                            group = int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True)
                            rows.append((*me, SEARCH, group, lo_x, raws[i][lo_x : hi_x + length]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return told.mapInArrow(run, "id long, hash long, act byte, minimizer long, start long, bytes binary")


def _search(rows: DataFrame, length: int, width: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, hash, gone): packed byte ranges to remove, found by the transforms; a minimizer's stretches stay together."""

    def judge(rows):
        owner = np.array([r[1] for r in rows])
        number, offset = repeated_windows([r[4] for r in rows], owner, length)
        start = np.array([r[3] for r in rows])[number] + offset
        doc, text = owner[number], np.array([r[2] for r in rows])[number]
        order = np.lexsort((text, doc))
        doc, text, start = doc[order], text[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
        cuts = np.flatnonzero(new)
        out = []
        for x, y in zip(cuts, np.append(cuts[1:], len(doc))):
            p, q = runs(start[x:y], start[x:y] + length)
            out.append((int(doc[x]), int(text[x]), np.stack([p, q], 1).astype("<i8").tobytes()))
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], ["id", "hash", "gone"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= batch_bytes and row[0] != held[-1][0]:
                    yield judge(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield judge(held)

    own = rows.where(F.col("act") == SEARCH).select("minimizer", "id", "hash", "start", "bytes")
    return own.repartition(width, "minimizer").sortWithinPartitions("minimizer").mapInArrow(run, "id long, hash long, gone binary")


def removed_ranges(docs: DataFrame, length: int = 50, hot: int = 20000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, gone array<binary>): per id and text hash packed (start, end) byte ranges to remove; they may overlap."""
    width = shuffle_width(docs.sparkSession)
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    long_enough = known.where(F.octet_length("text") >= length)
    announced = _announce(long_enough, length, 8 * width)
    verdicts = _verdicts(announced, hot, width).groupBy("id").agg(F.collect_list("verdict").alias("verdict"))
    told = long_enough.join(verdicts, "id").select("id", F.xxhash64("text").alias("hash"), "text", "verdict")
    rows = materialize(_apply(told, length), "stretches", tidy=True)
    found = _search(rows, length, width)
    gone = rows.where(F.col("act") == REMOVE).select("id", "hash", F.col("bytes").alias("gone")).union(found)
    out = materialize(gone.groupBy("id", "hash").agg(F.collect_list("gone").alias("gone")), "gone", tidy=True)
    discard([rows])
    return out


def cut(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """docs' (id, n_bytes, n_removed, n_spans, kept_sha256), or with ``as_text`` all of docs with the text replaced.

    Bytes are cut, so a cut may halve a character; ``as_text`` drops such halves.
    """
    gone = ranges.select(F.struct(F.col("id"), F.col("hash")).alias("key"), F.col("gone").alias("gone"))
    if not as_text:
        docs = docs.select(id_col, text_col)
    # input columns stay in a struct, so that no name can clash
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(gone, "key", "left").select("row", "gone")
    schema = docs.schema if as_text else f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches):
        for b in batches:
            kept, rows = [], []
            row = b.column(0).flatten()
            for text, gone in zip(row[at].to_pylist(), b.column(1).to_pylist()):
                raw = _raw(text)
                pairs = np.frombuffer(b"".join(gone or []), "<i8").reshape(-1, 2)
                p, q = runs(pairs[:, 0], pairs[:, 1])
                parts = b"".join([raw[x:y] for x, y in zip([0, *q.tolist()], [*p.tolist(), len(raw)])])
                kept.append(text if not len(p) else parts.decode("utf-8", "ignore"))
                rows.append((len(raw), int((q - p).sum()), len(p), hashlib.sha256(parts).hexdigest()))
            if as_text:
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if i == at else c for i, c in enumerate(row)], docs_columns)
            elif rows:
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([row[id_at], *cols], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs_columns = docs.columns
    return joined.mapInArrow(run, schema)


def dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    return cut(docs, removed_ranges(docs, length, id_col=id_col, text_col=text_col), id_col, text_col, as_text)
