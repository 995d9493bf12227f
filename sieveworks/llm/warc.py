"""WARC archives: write pages as records, read archives back, reassemble segmented records.

Writer: every row of pages becomes one HTTP response record; payloads of at least ``revisit_bytes``
that occur more than once are stored with the largest id, the others revisit it.  Bodies use chunked
transfer framing; a record whose block exceeds ``segment_bytes`` is split into a first segment and
continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID, WARC-Segment-Total-Length).
Archives are rows of gzip members, one per record, ``archive_records`` records each.

Reader: parses any archive, groups segments by origin identifier, orders them by number, verifies
the total length and decodes chunked framing.  An incomplete, doubled or wrongly long chain keeps
its row with the reason in ``error`` and no payload.

Every record has an identifier of its own; the page id stands in a field beside it, and a revisit names
the page id of the response it stands for.

Defined results: null html is the empty payload; rows with equal or null ids are separate records, so
as many rows come back as went in; a null id is read back as null; of equal payloads under one id, the
largest, each is a response; large payloads without any id are responses; other columns are ignored.
Sizes and digests reported for responses are those of the payload read back, null if it did not come back.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = b"\r\n"


def chunked(body: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """Decode chunked framing (extensions and trailers ignored); ValueError if it is broken off or malformed."""
    parts, p = [], 0
    while True:
        e = body.find(CRLF, p)
        if e < 0:
            raise ValueError("chunk size missing")
        n = int(body[p:e].split(b";")[0], 16)
        if n == 0:
            return b"".join(parts)
        part = body[e + 2 : e + 2 + n]
        if len(part) < n or body[e + 2 + n : e + 4 + n] != CRLF:
            raise ValueError("chunk broken off")
        parts.append(part)
        p = e + 4 + n


def record(kind: str, ident: str, block: bytes, **fields) -> bytes:
    """One WARC record; underscores in field names stand for hyphens."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes):
    """(fields, block) of every record; names in lower case."""
    p = 0
    while p < len(data):
        e = data.find(b"\r\n\r\n", p)
        if e < 0 or data[p : p + 5] != b"WARC/":
            raise ValueError("not a WARC record")
        fields = {}
        for line in data[p:e].split(CRLF)[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        n = int(fields["content-length"])
        yield fields, data[e + 4 : e + 4 + n]
        p = e + 4 + n + 4


def members(data: bytes):
    """The decompressed gzip members of an archive."""
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data) + z.flush()
        data = z.unused_data


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, segment_bytes: int = 32768, archive_records: int = 256) -> DataFrame:
    """(archive binary) rows.  Only digests, sizes and ids are shuffled to find revisits, and then each page once."""
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("body"))
    page = page.withColumn("digest", F.sha1("body")).withColumn("size", F.length("body"))
    keeper = page.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    rows = page.join(keeper.select("digest", "keeper"), "digest", "left").select("id", "url", "body", "digest", "keeper")

    def run(batches):
        for b in batches:
            out, count = [], 0
            for ident, url, body, digest, keeper in zip(*(c.to_pylist() for c in b.columns)):
                # equal ids may share the keeper's number; only rows with another number revisit it
                revisit = keeper is not None and ident != keeper
                name = uuid.uuid4().urn
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                common = {"WARC_Target_URI": None if url is None else url.replace("\r", "").replace("\n", ""), "X_Page_ID": ident, "WARC_Payload_Digest": f"sha1:{digest}", "X_Payload_Length": len(body)}
                if revisit:
                    own = [record("revisit", name, head, X_Refers_To_Page_ID=keeper, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **common)]
                else:
                    block = head + chunked(body)
                    cut = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                    own = [record("response", name, cut[0], WARC_Segment_Number=1 if len(cut) > 1 else None, **common)]
                    for k, part in enumerate(cut[1:], 2):
                        own.append(record("continuation", uuid.uuid4().urn, part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(cut) else None))
                for r in own:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.append(z.compress(r) + z.flush())
                    count += 1
                    if count == archive_records:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])
                        out, count = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

    return rows.mapInArrow(run, "archive binary")


#: Columns that whole records keep; refers_to is the identifier that a foreign archive gives, refers_to_page our own page id.
_KEEP = "record_id string, record_type string, page_id long, refers_to string, refers_to_page long, digest string, payload_length long, url string"
_FIELDS = f"origin_id string, segment int, total_length long, {_KEEP}, block binary"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _columns(fields: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [f.split() for f in fields.split(", ")]
    return [n for n, _ in pairs], [_ARROW[t] for _, t in pairs]


def records(archives: DataFrame, archive_col: str = "archive") -> DataFrame:
    """One row per record of the archives, segments not yet joined."""
    names, kinds = _columns(_FIELDS)

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for member in members(data or b""):
                    for f, block in parse(member):
                        number = lambda k: int(f[k]) if k in f else None
                        bare = lambda k: f[k].strip("<>") if k in f else None
                        digest = f.get("warc-payload-digest", "")
                        segment = bare("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length")
                        rows.append((*segment, bare("warc-record-id"), f["warc-type"], number("x-page-id"), bare("warc-refers-to"), number("x-refers-to-page-id"), digest.rpartition(":")[2] or None, number("x-payload-length"), f.get("warc-target-uri"), block))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return archives.select(archive_col).mapInArrow(run, _FIELDS)


def _body(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _finish(segments: list[tuple[int | None, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """The payload of one record's segments (number, total length, block), or why there is none."""
    numbers = sorted(n or 1 for n, _, _ in segments)
    if numbers != list(range(1, len(numbers) + 1)):
        return None, "segments missing or doubled"
    block = b"".join(part for _, _, part in sorted(segments, key=lambda s: s[0] or 1))
    totals = {t for _, t, _ in segments if t is not None}
    if (len(segments) > 1 or segments[0][0] == 1) and totals != {len(block)}:
        return None, "total length differs"
    try:
        return _body(block), None
    except ValueError as e:
        return None, str(e)


def reassemble(rows: DataFrame) -> DataFrame:
    """(record_id, record_type, page_id, refers_to, refers_to_page, digest, payload_length, url, payload, error): whole records as they are, segments by origin.

    Only records that have segment numbers are shuffled; a chain's segments meet in one task by their nature.
    """
    schema = f"{_KEEP}, payload binary, error string"
    names, kinds = _columns(schema)
    keep = names[:-2]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    def whole(batches):
        for b in batches:
            head = list(zip(*(b.column(b.schema.names.index(k)).to_pylist() for k in keep)))
            out = []
            for h, block in zip(head, b.column(b.schema.names.index("block")).to_pylist()):
                out.append((*h, *((None, None) if h[1] == "revisit" else _finish([(None, None, block)]))))
            if out:
                yield batch(out)

    def chains(batches):
        for b in batches:
            out = []
            for head, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                first = head or {k: None for k in keep}
                payload, error = _finish([(p["segment"], p["total_length"], p["block"]) for p in parts]) if head else (None, "first segment missing")
                out.append((*(first[k] for k in keep), payload, error))
            if out:
                yield batch(out)

    alone = rows.where("segment IS NULL").mapInArrow(whole, schema)
    chain = F.coalesce("origin_id", "record_id")
    joined = rows.where("segment IS NOT NULL").groupBy(chain.alias("chain")).agg(F.first(F.when(F.col("origin_id").isNull(), F.struct(*keep)), ignorenulls=True).alias("head"), F.collect_list(F.struct("segment", "total_length", "block")).alias("parts"))
    return alone.unionByName(joined.mapInArrow(chains, schema))


def page_report(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error) per page; those of responses are taken from the payload read back."""
    revisit = F.col("record_type") == "revisit"
    return found.select(
        "page_id",
        F.when(revisit, F.col("payload_length")).otherwise(F.length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").alias("refers_to"),
        "error",
    )


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()
