"""GIF columns: write payloads as GIF89a images, decode LZW streams, compose timed frames.

The decoder handles global and local palettes, interlacing, transparency, all four disposal
methods and any number of frames.  ``frames`` stores one row per timed frame with colour
histograms; ``encode_payloads`` / ``read_payloads`` keep arbitrary bytes as 8-bit samples
under an identity grey palette, so that the samples survive palette application.

Defined results: a null text is the empty text (192 blanks); null ids pass through; every
input row gives one output row, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import reduce
from operator import getitem

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

WIDTH = 192
MAX_HEIGHT = 65535
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _widths(min_code: int) -> np.ndarray:
    """Bits of the j-th code after a clear code (before any table-full phase): the table has grown by j entries."""
    last = (1 << min_code) + 1 + np.arange(5000)
    return np.clip(np.ceil(np.log2(last + 1)).astype(np.int64), min_code + 1, 12)


_STEPS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _steps(min_code: int) -> tuple[np.ndarray, np.ndarray]:
    if min_code not in _STEPS:
        w = _widths(min_code)
        _STEPS[min_code] = w, np.concatenate([[0], np.cumsum(w)])
    return _STEPS[min_code]


class _Node(dict):
    """A table string; reading a missing child ends the match: its code goes out, the child joins the table."""

    __slots__ = ("code",)

    def __missing__(self, sample):
        codes = _Node.codes
        codes.append(self.code)
        child = self[sample] = _Node()
        child.code = n = len(codes) + _Node.shift
        if n == 4095:
            _restart()
        return _Node.roots[sample]


def _restart() -> None:
    for node in _Node.roots:
        node.clear()
    _Node.codes.append(256)
    _Node.clears.append(len(_Node.codes) - 1)
    _Node.shift = 257 - len(_Node.codes)


_Node.roots = []
for _i in range(256):
    _Node.roots.append(_Node())
    _Node.roots[-1].code = _i


def lzw_encode_many(payloads: list[bytes]) -> list[bytes]:
    """8-bit LZW streams, each with a clear code first and whenever the table fills; packed together in one go."""
    codes = _Node.codes = []
    clears = _Node.clears = []
    firsts = []
    for data in payloads:
        firsts.append(len(codes))
        _restart()
        if data:
            codes.append(reduce(getitem, data[1:], _Node.roots[data[0]]).code)
        codes.append(257)
    code, clear, first = np.array(codes, np.int64), np.array(clears), np.array(firsts)
    here = np.arange(len(code))
    since = here - 1 - clear[np.searchsorted(clear, here - 1, side="right") - 1]
    width = _steps(8)[0][np.maximum(since, 0)]
    width[first] = 9
    end = np.cumsum(width)
    ends = end[np.append(first[1:], len(code)) - 1]
    bits = np.diff(ends, prepend=0)
    size = (bits + 7) >> 3
    start = np.cumsum(size) - size
    off = end - width + np.repeat(start * 8 - (ends - bits), np.diff(np.append(first, len(code))))
    spread, byte, total = code << (off & 7), off >> 3, int(size.sum())
    packed = sum(np.bincount(byte + i, (spread >> 8 * i) & 255, total + 3) for i in range(3))  # bits of different codes never overlap
    raw = packed.astype(np.uint8).tobytes()
    return [raw[a : a + n] for a, n in zip(start.tolist(), size.tolist())]


def _expand(code: np.ndarray, clear: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of many runs of codes, each between two clear codes, and every code's share of them (0: invalid).

    clear and begin: per code, its clear code and where its run begins.  Table entry clear + 2 + k is the string of
    the run's k-th code plus the next string's first sample, which lie side by side in the output.  So every code
    copies earlier output, one sample more than its parent code gave; lengths and samples follow from the parents
    by pointer jumping instead of a loop over codes.
    """
    j = np.arange(len(code), dtype=np.int32)
    literal = code < clear
    parent = np.where(literal, j, code - clear - 2 + begin).astype(np.int32)
    bad = (~literal & (parent >= j)) | (parent < begin)
    if bad.any():  # a run ends at its first invalid code
        bad = np.maximum.accumulate(np.where(bad, begin + 1, 0)) > begin
        parent = np.where(bad, j, parent)
        literal = literal | bad
    gain = np.where(literal, 0, 1).astype(np.int32)  # samples more than at up
    up = parent
    while (above := gain[up]).any():
        gain = gain + above
        up = up[up]
    length = gain + 1
    if bad.any():
        length[bad] = 0
    at = (np.cumsum(length) - length).astype(np.int32)
    source = np.repeat(at[parent] - at, length) + np.arange(int(length.sum()), dtype=np.int32)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    values = np.zeros(len(source), np.uint8)
    start = literal & (length > 0)
    values[at[start]] = code[start]
    return values[source], length


def _runs(stream: bytes, min_code: int, limit: int):
    """The runs of codes between clear codes; all code widths up to the next clear code are known beforehand."""
    clear, stop = 1 << min_code, (1 << min_code) + 1
    grow, at = _steps(min_code)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int32)
    bits, pos, count = len(stream) * 8, 0, 0
    while pos < bits and count < limit:
        n = min(int(np.searchsorted(at, bits - pos, side="right")) - 1, len(grow))
        more = max(0, bits - pos - int(at[n])) // 12 if n == len(grow) else 0  # table full without a clear code: 12 bits each
        off, w = at[:n] + pos, grow[:n]
        if more:
            off, w = np.concatenate([off, at[n] + pos + 12 * np.arange(more)]), np.concatenate([w, np.full(more, 12)])
        if not len(off):
            return
        byte = off >> 3
        got = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (off & 7)) & ((1 << w) - 1)
        control = (got == clear) | (got == stop)
        cut = int(control.argmax()) if control.any() else len(got)
        if cut:
            yield got[:cut]
            count += cut
        if cut == len(got) or int(got[cut]) == stop:
            return
        pos = int(off[cut] + w[cut])


def lzw_decode_many(streams: list[tuple[bytes, int, int]]) -> list[bytes]:
    """(code stream, minimum code size, limit of samples) -> samples; damaged streams give what came before the damage."""
    runs, sizes, clears, counts = [], [], [], []
    for stream, min_code, limit in streams:
        own = list(_runs(stream, min_code, limit))
        runs += own
        sizes += map(len, own)
        clears += [1 << min_code] * len(own)
        counts.append(sum(map(len, own)))
    if not runs:
        return [b""] * len(streams)
    size = np.array(sizes)
    values, length = _expand(np.concatenate(runs), np.repeat(clears, size), np.repeat(np.cumsum(size) - size, size))
    raw, ends = values.tobytes(), np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)].tolist()
    return [raw[a:b][:limit] for a, b, (_, _, limit) in zip([0, *ends], ends, streams)]


def lzw_decode(stream: bytes, min_code: int, limit: int) -> bytes:
    return lzw_decode_many([(stream, min_code, limit)])[0]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(c)]) + c for c in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def write_gifs(payloads: list[bytes], delay_cs: int = 10) -> list[bytes]:
    """8-bit samples, each a positive multiple of WIDTH long, as grey frames of at most 65535 lines each."""
    cut = [[p[i : i + WIDTH * MAX_HEIGHT] for i in range(0, len(p), WIDTH * MAX_HEIGHT)] for p in payloads]
    streams = iter(lzw_encode_many([f for own in cut for f in own]))
    out = []
    for own in cut:
        parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(own[0]) // WIDTH, 0xF7, 0, 0), GREY]
        for f in own:
            parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0"]
            parts += [b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(f) // WIDTH, 0), b"\x08", _blocks(next(streams))]
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def parse_gif(data: bytes) -> tuple[int, int, list[dict]]:
    """(width, height, frames); a frame has its rectangle, palette, timing, disposal and undecoded code stream."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    p, shared, found = 13, None, []
    delay, disposal, hidden = 0, 0, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, p = np.frombuffer(data, np.uint8, n, p).reshape(-1, 3), p + n
    while p < len(data) and data[p] != 0x3B:
        if data[p] == 0x21:
            if data[p + 1] == 0xF9:
                packed, delay, index = struct.unpack("<BHB", data[p + 3 : p + 7])
                disposal, hidden = packed >> 2 & 7, index if packed & 1 else None
            p += 2
            while data[p]:
                p += data[p] + 1
            p += 1
            continue
        if data[p] != 0x2C:
            raise ValueError("unknown GIF block")
        x, y, w, h, packed = struct.unpack("<HHHHB", data[p + 1 : p + 10])
        p += 10
        palette = shared
        if packed & 0x80:
            n = 3 << ((packed & 7) + 1)
            palette, p = np.frombuffer(data, np.uint8, n, p).reshape(-1, 3), p + n
        if palette is None:
            raise ValueError("frame without palette")
        min_code, p, parts = data[p], p + 1, []
        if not 2 <= min_code <= 8:
            raise ValueError("minimum code size out of range")
        while data[p]:
            parts.append(data[p + 1 : p + 1 + data[p]])
            p += data[p] + 1
        p += 1
        found.append({"box": (x, y, w, h), "palette": palette, "interlaced": bool(packed & 0x40), "delay": delay, "disposal": disposal, "hidden": hidden, "stream": (b"".join(parts), min_code, w * h)})
        delay, disposal, hidden = 0, 0, None
    return wide, high, found


def compose(wide: int, high: int, parsed: list[dict], samples: list[bytes]):
    """Yield (start_ms, delay_ms, box, canvas) per frame; canvas is the composed RGBA picture, reused between frames."""
    canvas = np.zeros((high, wide), np.uint32)
    clock = 0
    for f, got in zip(parsed, samples):
        x, y, w, h = f["box"]
        index = np.frombuffer(got + b"\0" * (w * h - len(got)), np.uint8).reshape(h, w)
        if f["interlaced"]:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        before = canvas.copy() if f["disposal"] == 3 else None
        lut = np.zeros((256, 4), np.uint8)
        lut[:, 3] = 255
        lut[: len(f["palette"]), :3] = f["palette"]
        lut = lut.view(np.uint32).ravel()
        spot = canvas[y : y + h, x : x + w]
        inside = index[: spot.shape[0], : spot.shape[1]]
        if f["hidden"] is None:
            spot[:] = lut[inside]
        else:
            shown = inside != f["hidden"]
            spot[shown] = lut[inside[shown]]
        yield clock * 10, f["delay"] * 10, f["box"], canvas.view(np.uint8).reshape(high, wide, 4)
        clock += f["delay"]
        if f["disposal"] == 2:
            spot[:] = 0
        elif f["disposal"] == 3:
            canvas = before


def read_gif(data: bytes):
    wide, high, parsed = parse_gif(data)
    return compose(wide, high, parsed, lzw_decode_many([f["stream"] for f in parsed]))


def histogram(canvas: np.ndarray, bins: int = 16) -> np.ndarray:
    """Counts of red, green and blue levels in ``bins`` equal classes, one channel after the other."""
    shift = 8 - int(np.log2(bins))
    return np.concatenate([np.bincount(canvas[..., c].ravel() >> shift, minlength=bins) for c in range(3)])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def encode_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8 bytes, padded with blanks to a positive multiple of 192, as a GIF."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, media = [], []
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                own = [padded(t) for t in texts[lo:hi]]
                n += [size for size, _ in own]
                media += write_gifs([raw for _, raw in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def decoded(media: list[bytes]):
    """(GIF, parsed GIF, each frame's samples), decoding about a megabyte of code streams at once."""
    for lo, hi in chunks(media):
        parsed = [parse_gif(g) for g in media[lo:hi]]
        samples = iter(lzw_decode_many([f["stream"] for _, _, own in parsed for f in own]))
        for gif, p in zip(media[lo:hi], parsed):
            yield gif, p, [next(samples) for _ in p[2]]


def read_payloads(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode stored GIFs to their samples (red channel of each frame's own rectangle) with digests and colour histogram."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms"]

    def run(batches):
        for b in batches:
            rows = []
            media = b.column(2).to_pylist()
            for gif, (wide, high, parsed), samples in decoded(media):
                parts, colour, time, count = [], np.zeros(48, np.int64), 0, 0
                for start, delay, (x, y, w, h), canvas in compose(wide, high, parsed, samples):
                    spot = canvas[y : y + h, x : x + w]
                    parts.append(spot[..., 0].tobytes())
                    colour += histogram(spot)
                    time, count = start + delay, count + 1
                raw = b"".join(parts)
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), ",".join(map(str, colour.tolist())), count, time))
            cols = list(zip(*rows)) if rows else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names)

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema)


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per timed frame: (id, frame, start_ms, delay_ms, width, height, rgba, histogram array<long>, error).

    A value that is null or no GIF gives one row with frame -1 and the reason in ``error``.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "frame", "start_ms", "delay_ms", "width", "height", "rgba", "histogram", "error"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def run(batches):
        for b in batches:
            for i, gif in enumerate(b.column(1).to_pylist()):
                rows = []
                try:
                    for k, (start, delay, _, canvas) in enumerate(read_gif(gif or b"")):
                        rows.append((k, start, delay, canvas.shape[1], canvas.shape[0], canvas.tobytes(), histogram(canvas).tolist(), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((-1, None, None, None, None, None, None, str(e)))
                if rows:
                    ids = b.column(0).slice(i, 1).take(pa.array([0] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names)

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, histogram array<bigint>, error string")
