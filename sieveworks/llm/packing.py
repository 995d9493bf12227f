"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Documents longer than the capacity are cut into full pieces behind a possibly shorter first one.
Pieces of one length are interchangeable, so the packing is planned on the counts per length
alone, at most ``capacity`` numbers whatever the size of the data: lengths come in decreasing
order, and a segment tree over the remaining capacities gives the tightest open bin in
logarithmic time.  Bins with equal remaining capacity are kept as ranges of numbers, so one step
serves a whole range of equal pieces.  The plan (a few thousand ranges) is broadcast; every piece
finds its place by its rank among the pieces of its length, which salted counts give without
gathering a length in one task.

Ids are those of the ``tokenizers`` library with its default settings; the merges are run by ``tiktoken``
from the same file's vocabulary.

Defined results: added tokens in a text (``<|endoftext|>``) are their ids; null text is the empty text, which still has its closing token; equal lengths are
ranked by salt, then id, then piece; repeated rows of one id are packed separately; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize, shuffle_width


#: White space of the word pattern.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of white space from this length on are cut out before the word pattern sees them, which goes back over runs step by step.
LONG_RUN = 1000


class Tokenizer:
    """Byte-level BPE from a tokenizer file, whose added tokens are found in texts unless ``special_as_text``."""

    def __init__(self, path: str, special_as_text: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix blank is needed")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(map(chr, plain), plain)) | dict(zip(map(chr, range(256, 324)), (b for b in range(256) if b not in set(plain))))
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take neighbouring characters along aren't supported")
        special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.ranks = {bytes(shown[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.special = {} if special_as_text else special
        # the longest of those that start at one place
        self.find = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.engine = None

    def __getstate__(self):
        return self.__dict__ | {"engine": None}

    def _plain(self, text: str) -> bytes:
        """Ids of text without added tokens."""
        one = self.engine.encode_ordinary
        if len(text) > LONG_RUN and _PAIR.search(text[:: LONG_RUN // 2]):  # every long run covers two of these characters
            parts, p = [], 0
            for m in _RUN.finditer(text):
                # before other text the run's last character stands with that text
                stop = m.end() if m.end() == len(text) else m.end() - 1
                parts += [text[p : m.start()], text[m.start() : stop]]
                p = stop
            return b"".join(np.array(one(x), "<u4").tobytes() for x in (*parts, text[p:]))
        return np.array(one(text), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids (little-endian uint32) of each text."""
        if self.engine is None:
            import tiktoken

            #: Fixed value: the public byte-level BPE word pattern.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.engine = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.find is not None and any(s in t for s in self.special):
                out.append(b"".join(self.special.get(x) or self._plain(x) for x in self.find.split(t) if x))
            else:
                out.append(self._plain(t))
        return out


_RUN = re.compile(_SPACE + "{%d,}" % LONG_RUN)
_PAIR = re.compile(_SPACE + "{2}")


def pieces(docs: DataFrame, tokenizer: Tokenizer, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    tail = np.array([end_id], "<u4").tobytes()
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                row, number, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(shared.value.encode(texts[lo:hi])):
                    ids += tail
                    n = len(ids) // 4
                    cut = n % capacity or capacity
                    a = k = 0
                    for e in range(cut, n + 1, capacity):
                        row.append(lo + i)
                        number.append(k)
                        start.append(a)
                        length.append(e - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * e]))
                        a, k = e, k + 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Segment tree over remaining capacities 0..capacity; a leaf counts its open bins."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)

    def add(self, room: int, bins: int) -> None:
        i = room + self.width
        while i:
            self.tree[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least ``need`` with an open bin, or -1."""
        i = need + self.width
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.width:
                    i *= 2
                    if not self.tree[i]:
                        i += 1
                return i - self.width
            i >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing on counts per length: (length, first rank, pieces, first bin, offset), one bin per piece."""
    tree = OpenBins(capacity)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by remaining capacity: (first bin, bins)
    steps, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                # best fit fills each new bin with this length before it opens the next
                first, per = bins, capacity // length
                full, rest = divmod(left, per)
                bins += full + (rest > 0)
                for k in range(per):
                    many = full + (k < rest)
                    if many:
                        steps.append((length, rank, many, first, k * length))
                        rank += many
                for lo, many, used in ((first, full, per), (first + full, 1 if rest else 0, rest)):
                    if many and used * length < capacity:
                        ranges[capacity - used * length].append((lo, many))
                        tree.add(capacity - used * length, many)
                left = 0
                continue
            first, many = ranges[room].pop()
            n = min(many, left)
            if n < many:
                ranges[room].append((first + n, many - n))
            tree.add(room, -n)
            steps.append((length, rank, n, first, capacity - room))
            if room > length:
                ranges[room - length].append((first, n))
                tree.add(room - length, n)
            left, rank = left - n, rank + n
    return steps


def pack(cut: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """cut (a stable table of pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    width = shuffle_width(spark)
    order = [c for c in (id_col, "piece", "start", "ids_crc32") if c in cut.columns]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(width)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    total = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    steps = plan(total, capacity)
    by_length: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}
    for length, rank, _, first, offset in steps:
        starts, places = by_length.setdefault(length, ([], []))
        starts.append(rank)
        places.append((first, offset))
    shared = spark.sparkContext.broadcast(by_length)
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_local", local).join(before.select("length", "_salt", "_before"), ["length", "_salt"])
    ranked = ranked.select(*cut.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("_rank"))
    at, rank_at = ranked.columns.index("length"), ranked.columns.index("_rank")
    out = ranked.drop("_rank")
    names = [*out.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields) + ", sequence_id long, offset long"

    def place(batches):
        for b in batches:
            seq, off = [], []
            for length, rank in zip(b.column(at).to_pylist(), b.column(rank_at).to_pylist()):
                starts, places = shared.value[length]
                k = bisect_right(starts, rank) - 1
                first, offset = places[k]
                seq.append(first + rank - starts[k])
                off.append(offset)
            cols = [c for i, c in enumerate(b.columns) if i != rank_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: Tokenizer, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for all pieces of docs."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity, id_col)
