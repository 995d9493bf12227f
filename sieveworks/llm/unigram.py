"""SentencePiece unigram encoding and decoding.

A model file's pieces and scores go into a double-array trie over UTF-8 bytes.  Encoding is a
Viterbi search for the segmentation with the largest sum of log scores (ties: the earlier
start of the last piece wins); characters that no piece covers fall back to byte pieces, or
to the unknown piece if the model has none.  Decoding joins pieces, bytes included, and turns
whitespace markers into blanks.

When no piece has a marker after another character (checked on loading), every blank starts
an independent search, and so does every line break that is in no piece; each distinct stretch of
text is searched once per Python worker (bounded cache, what was not met for a generation goes) and
whole batches of stretches advance through the trie together as arrays.

Defined results: null text gives null ids, the empty text no ids; decoding null gives null,
ids outside the vocabulary raise; a marker that stands in the text itself decodes as a blank.  Rows pass one to one, repeated rows included.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks

MARK = "▁"
#: Piece types of the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Score of the unknown piece below the smallest score of a piece.
UNKNOWN_PENALTY = 10.0
#: Characters of stretches that go through the trie together.
BATCH_CHARS = 1 << 16


def _fields(data: bytes):
    p = 0

    def varint(p):
        value = shift = 0
        while True:
            x = data[p]
            value |= (x & 127) << shift
            p, shift = p + 1, shift + 7
            if x < 128:
                return value, p

    while p < len(data):
        key, p = varint(p)
        if key & 7 == 0:
            value, p = varint(p)
        elif key & 7 == 2:
            n, p = varint(p)
            value, p = data[p : p + n], p + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, p = data[p : p + n], p + n
        yield key >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) in order of id from a SentencePiece model file."""
    out = []
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            out.append((own[1].decode(), score, own.get(3, NORMAL)))
    return out


class DoubleArray:
    """Trie in two integer arrays: child c of node s is t = base[s] + c when check[t] == s; value[t] is a piece id or -1."""

    def __init__(self, words: list[tuple[bytes, int]]):
        tree: list[dict[int, int]] = [{}]
        leaf = [-1]
        for word, ident in words:
            s = 0
            for c in word:
                if c not in tree[s]:
                    tree[s][c] = len(tree)
                    tree.append({})
                    leaf.append(-1)
                s = tree[s][c]
            leaf[s] = ident
        size = 2 * len(tree) + 1024
        used = bytearray(size)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used[0] = 1
        place = {0: 0}
        low = tail = 1
        for s in range(len(tree)):
            kids = sorted(tree[s])
            if not kids:
                continue
            while used[low]:
                low += 1
            b = max(1, low - kids[0])
            for _ in range(32):  # a few tries near the first gap, then behind everything
                if not any(used[b + c] for c in kids):
                    break
                b += 1
            else:
                b = max(1, tail - kids[0])
            tail = max(tail, b + kids[-1] + 1)
            if tail + 512 >= size:
                used += bytes(size)
                base, check, value = (np.concatenate([a, np.full(size, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                size *= 2
            at = place.pop(s)
            base[at] = b
            for c in kids:
                used[b + c] = 1
                check[b + c] = at
                value[b + c] = leaf[tree[s][c]]
                place[tree[s][c]] = b + c
        n = tail + 257
        pad = max(0, n - size)
        self.base, self.check, self.value = (np.pad(a, (0, pad), constant_values=-1)[:n] for a in (base, check, value))


class Model:
    """The pieces of a model file with its trie; pickled to the Python workers once per query."""

    def __init__(self, data: bytes, cache_size: int = 200_000):
        pieces = read_model(data)
        self.pieces = [p.encode() for p, _, _ in pieces]
        self.scores = np.array([s for _, s, _ in pieces])
        self.kinds = np.array([k for _, _, k in pieces])
        normal = [(p.encode(), i) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)]
        self.trie = DoubleArray(normal)
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.unknown_score = float(self.scores[self.kinds == NORMAL].min()) - UNKNOWN_PENALTY
        by_text = {p: i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_ids = [by_text[f"<0x{b:02X}>"] for b in range(256)] if len(by_text) == 256 else None
        self.bytes_of = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else p.encode() for p, _, k in pieces]
        #: Whether every marker starts an independent search.
        self.splits = not any(MARK in p.lstrip(MARK) for p, _, k in pieces if k in (NORMAL, USER))
        #: A line break that is in no piece is a piece of its own in every segmentation, so it starts an independent search too.
        self.lines = self.splits and not any("\n" in p for p, _, k in pieces if k in (NORMAL, USER))
        self.cache_size = cache_size
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "older": {}}

    def viterbi(self, stretches: list[bytes]) -> list[bytes]:
        """The ids (little-endian int32) of each UTF-8 stretch's best segmentation."""
        n = np.array([len(s) for s in stretches])
        raw = np.frombuffer(b"".join(stretches), np.uint8).astype(np.int32)
        end = np.cumsum(n)
        begin = end - n
        owner = np.repeat(np.arange(len(n)), n)
        limit = end[owner]
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        char_len = np.diff(np.append(starts, len(raw)))
        single = np.zeros(len(raw), bool)
        # all starts walk down the trie together
        at, node, depth = starts, np.zeros(len(starts), np.int32), 0
        found = []
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        length_of = np.zeros(len(raw), np.int64)
        length_of[starts] = char_len
        while len(at):
            inside = at + depth < limit[at]
            at, node = at[inside], node[inside]
            t = base[node] + raw[at + depth]
            good = check[t] == node
            at, node, depth = at[good], t[good], depth + 1
            hit = value[node] >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth), value[node][hit]))
            single[at[hit][length_of[at[hit]] == depth]] = True
        lone = starts[~single[starts]]
        found.append((lone, length_of[lone], np.full(len(lone), self.unknown)))
        start, size, piece = (np.concatenate(x) for x in zip(*found))
        gain = np.where(piece == self.unknown, self.unknown_score, self.scores[piece])
        offset = start - begin[owner[start]]
        order = np.lexsort((size, offset))
        start, size, piece, gain, offset = start[order], size[order], piece[order], gain[order], offset[order]
        # nodes: one more per stretch than bytes
        slot = start + owner[start]
        best = np.full(len(raw) + len(n), -np.inf)
        best[begin + np.arange(len(n))] = 0.0
        back, via = np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        cuts = np.flatnonzero(np.diff(offset, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(start))):
            score = best[slot[a:b]] + gain[a:b]
            to = slot[a:b] + size[a:b]
            better = score > best[to]
            to = to[better]
            best[to], back[to], via[to] = score[better], slot[a:b][better], piece[a:b][better]
        # walk back from all ends together
        who = np.flatnonzero(n > 0)
        here = end[who] + who
        steps, step = [], 0
        while len(who):
            steps.append((who, np.full(len(who), step), via[here], back[here], here))
            here = back[here]
            more = here > begin[who] + who
            who, here, step = who[more], here[more], step + 1
        who, step, ids, lo, hi = (np.concatenate(x) for x in zip(*steps)) if steps else [np.zeros(0, np.int64)] * 5
        order = np.lexsort((-step, who))
        who, ids, lo, hi = who[order], ids[order], lo[order] - who[order], hi[order] - who[order]
        if self.byte_ids is not None and (ids == self.unknown).any():
            reps = np.where(ids == self.unknown, hi - lo, 1)
            first = np.repeat(np.cumsum(reps) - reps, reps)
            spot = np.repeat(lo, reps) + np.arange(len(first)) - first
            lost = np.repeat(ids == self.unknown, reps)
            ids = np.where(lost, np.array(self.byte_ids)[raw[np.minimum(spot, len(raw) - 1)]], np.repeat(ids, reps))
            who = np.repeat(who, reps)
        flat = ids.astype("<i4").tobytes()
        stops = np.cumsum(np.bincount(who, minlength=len(n))) * 4
        return [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian int32) per text, with a marker before the text and for each blank."""
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif not self.splits:
                cut.append([t.replace(" ", MARK)])
            elif MARK not in t and "  " not in t and t[0] != " " and t[-1] != " ":
                cut.append((t.replace("\n", " \n") if self.lines else t).split(" "))
            else:
                # keys lack the stretch's first marker, as those of split() do
                own = [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK))]
                cut.append([x for w in own for x in (("", w) if self.lines and w[:1] == "\n" else (w,))])
        if len(self.cache) > self.cache_size:  # what was not met for a whole generation goes
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        lost = {w for own in cut for w in own if w not in cache}
        cache.update((w, older[w]) for w in lost if w in older)
        new = sorted(w for w in lost if w not in cache)
        raw = lambda w: w if self.lines and w[:1] == "\n" else MARK + w
        for lo, hi in chunks(new, BATCH_CHARS):
            cache.update(zip(new[lo:hi], self.viterbi([raw(w).encode("utf-8", "surrogatepass") for w in new[lo:hi]])))
        return [b"".join(map(cache.__getitem__, own)) for own in cut]

    def decode(self, ids: list[int]) -> str:
        return self.finish(b"".join(map(self.bytes_of.__getitem__, ids)))

    @staticmethod
    def finish(spelled: bytes) -> str:
        """The text of joined pieces: markers become blanks, the one before the text goes."""
        raw = spelled.decode("utf-8", "replace").replace(MARK, " ")
        return raw[1:] if raw[:1] == " " else raw


def encode(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens, n_byte_pieces, ids_crc32) per row."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        is_byte = m.kinds == BYTE
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                got = m.encode([t or "" for t in texts[lo:hi]])
                flat = np.frombuffer(b"".join(got), "<i4")
                size = np.array([len(g) // 4 for g in got])
                stops = np.concatenate([[0], np.cumsum(size)])
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[flat])])
                null = pa.array([t is None for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat), mask=null),
                        pa.array(size, pa.int64()),
                        pa.array(bytes_before[stops[1:]] - bytes_before[stops[:-1]], pa.int64()),
                        pa.array([zlib.crc32(g) for g in got], pa.int64()),
                    ],
                    [id_col, "ids", "n_tokens", "n_byte_pieces", "ids_crc32"],
                )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, n_byte_pieces long, ids_crc32 long")


def decode(df: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the decoded text as a further column (replacing one of that name)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])
    at = df.columns.index(ids_col)

    def run(batches):
        m = shared.value
        pieces = pa.array(m.bytes_of, pa.binary())
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = part.column(at)
                stops = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
                spelled = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pieces.take(ids.flatten()), mask=ids.is_null())
                texts = [None if x is None else m.finish(x) for x in pc.binary_join(spelled, b"").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=pa.schema([*part.schema, pa.field(text_col, pa.string())]))

    return df.mapInArrow(run, schema)
