"""WARC archives: writing with revisits, segments and chunked framing, and reading back.

A record that is longer than SEGMENT bytes is cut into a first segment and
continuation records. The reader takes unsegmented records as they come; segments
are grouped by their origin's id, ordered by number, checked against the total length
and joined. Then the chunked transfer framing is taken off and the payload's
digest is checked against the header's.

Files are written by Spark's text writer: each row is one record as a gzip member of
its own, and the line separator is an empty member, so a part file is a
plain .warc.gz; reading uses Spark's binaryFile source, on files of at most
FILE_RECORDS records. Which payloads repeat is a grouping by digest that is summed
before it is shuffled.

Defined cases: a null html counts as empty. A null page_id is written as such and
never the smallest; rows that repeat give records that repeat, with one row each
(equal records have equal ids and equal segments, and count as often as their first
segment). An empty table gives an empty result. A record that fails a check
raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, new_dir, table

#: Payloads from this length on are written once and revisited.
LEAST_REVISITED = 100
SEGMENT, CHUNK, FILE_RECORDS = 16 << 10, 4 << 10, 4000
DATE = "2025-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions after ; and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        size = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def page_of(urn: str) -> str | None:
    return urn.removeprefix("<urn:x-page:").rpartition(":")[0] or None


def records(page: str | None, url: str | None, payload: bytes | None, size: int, digest: str, first: str | None) -> Iterator[bytes]:
    """The records of one page; first is the page that a revisit refers to."""
    me = record_id(page, digest)
    uri = "".join(c for c in url if c > " ") if url else "urn:x-page:none"
    head: list[tuple[str, object]] = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Record-ID", me),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if first is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest))]
        yield record(head, HTTP + b"Content-Length: %d\r\n\r\n" % size)
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload or b"")
    if len(block) <= SEGMENT:
        yield record(head, block)
        return
    n = -(-len(block) // SEGMENT)
    for k in range(n):
        part = block[k * SEGMENT : (k + 1) * SEGMENT]
        if not k:
            yield record([*head, ("WARC-Segment-Number", 1)], part)
            continue
        more: list[tuple[str, object]] = [("WARC-Type", "continuation"), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Record-ID", me[:-1] + f":{k + 1}>"), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", k + 1)]
        yield record([*more, ("WARC-Segment-Total-Length", len(block) if k == n - 1 else None)], part)


def _write_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out, held = [], 0
        for row in zip(*[b.column(c) for c in ("page", "url", "payload", "size", "digest", "first")], strict=True):
            for r in records(*[x.as_py() for x in row]):
                out.append(member(r))
                held += len(out[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record per row of df to .warc.gz files below path."""
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    d = df.select(
        F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"), text.cast("binary").alias("payload"),
        F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("digest"),
    )
    same = d.where(F.col("size") >= LEAST_REVISITED).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = d.join(same, "digest", "left").select(
        F.col("id").cast("string").alias("page"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
        F.when(revisit, F.col("first").cast("string")).alias("first"),
    )
    members = rows.mapInArrow(_write_batches, "record binary").select(F.col("record").cast("string").alias("value"))
    between = member(b"").decode("latin-1")
    members.write.option("encoding", "ISO-8859-1").option("lineSep", between).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def unzipped(content: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one at a time, empty ones left out."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + (32 << 10)]
            if not piece:
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if any(parts):
            yield b"".join(parts)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records in a run of bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        at = end + 4
        block = data[at : at + size]
        if len(block) != size or data[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')}: the block is not as long as its header says")
        yield headers, block
        at += size + 4


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(page: str | None, digest: str, block: bytes) -> tuple[int, str]:
    payload = payload_of(block)
    got = hashlib.sha256(payload).hexdigest()
    if got != digest:
        raise ValueError(f"page {page}: the payload's digest is not the header's")
    return len(payload), got


READ = pa.schema([
    ("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string()),
    ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary()),
])
READ_DDL = "page string, payload_bytes long, payload_digest string, record_type string, refers string, origin string, number long, total long, block binary"


def _read_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for content in b.column("content"):
            rows: list[tuple] = []
            for data in unzipped(content.as_py()):
                for h, block in parsed(data):
                    kind, me = h["warc-type"], h["warc-record-id"]
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
                    page = page_of(me)
                    if kind == "continuation" or "warc-segment-number" in h:
                        total = h.get("warc-segment-total-length")
                        rows.append((page if kind == "response" else None, None, digest or None, kind, None, h.get("warc-segment-origin-id", me), int(h["warc-segment-number"]), total and int(total), block))
                    elif kind == "revisit":
                        size = next(int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        rows.append((page, size, digest, kind, page_of(h["warc-refers-to"]), None, None, None, None))
                    elif kind == "response":
                        rows.append((page, *_checked(page, digest, block), kind, None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(READ)], schema=READ)


def _join_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = []
        for segments in b.column("segments"):
            parts = segments.as_py()  # by number; equal records bring equal numbers
            head, times = parts[0], sum(p["number"] == 1 for p in parts)
            by = {p["number"]: p for p in parts}
            block = b"".join(by[k]["block"] for k in range(1, len(by) + 1))
            if by[len(by)]["total"] != len(block):
                raise ValueError(f"page {head['page']}: segments hold {len(block)} bytes, not {by[len(by)]['total']}")
            rows += [(head["page"], *_checked(head["page"], head["payload_digest"], block), "response", None)] * times
        names = READ.names[:5]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], READ.field(k).type) for k in range(5)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers) of the archives below path; ids are strings."""
    files = spark.read.format("binaryFile").load(path).select("content")
    got = cut(files.mapInArrow(_read_batches, READ_DDL), "warc-records")
    whole = got.where("number IS NULL").select(*READ.names[:5])
    part = F.struct("number", "page", "payload_digest", "total", "block")
    segments = got.where("number IS NOT NULL").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("segments"))
    joined = segments.select("segments").mapInArrow(_join_batches, ", ".join(READ_DDL.split(", ")[:5]))
    return whole.unionByName(joined)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = new_dir(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    return read(spark, path).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f"""
}
