"""WARC archives: pages written as segmented records with chunked bodies, and read back whole.

An archive is a row ``archive, content`` of about 8 MB of WARC 1.1 records. A response record holds an
HTTP response whose body is framed in chunks. Where that is longer than a segment, the record is the
first segment and continuation records follow, which name its record as their origin, count on from
segment 2, and (the last one) give the total length. Reading groups the segments of an origin,
orders them by number, verifies the total length, takes the chunk framing off, and checks the digest.

Of pages with equal payloads, the one with the largest id is the response and the others are revisit
records without a body, which name the response's record and say how long the payload is. Only ids and digests
meet in a shuffle by payload; a payload that very many pages have is spread by their ids when it is looked up.

Defined results: a null html is an empty payload; a null page id is smaller than any other, and is
kept as null; rows repeated with one page id and payload are all responses, or all revisits; an
empty table gives no archives; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ARCHIVE_BYTES = 8 << 20
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4096
#: Options to write archives as Parquet. Else the writer looks at sizes every 100 rows only, holds as many archives in one
#: page, and whoever reads the file gets them at once; and it holds a least and a greatest archive until the file is closed.
PARQUET = {"parquet.block.row.count.limit": "1", "parquet.column.statistics.enabled": "false", "parquet.enable.dictionary": "false"}
#: What Python workers get and give at once.
BATCH_BYTES = 1 << 20

ARCHIVE = "archive string, content binary"
_SEGMENT = pa.schema(
    [("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("content", pa.binary())]
)
SEGMENT = "origin string, segment bigint, total bigint, kind string, page_id bigint, refers_to bigint, digest string, size bigint, content binary"
_PAGE = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
PAGE = "page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


class BrokenArchive(ValueError):
    """A record, a chunk, a total length or a digest that does not hold."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    framed = b"".join(b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size))
    return framed + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    body, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            raise BrokenArchive("chunk size")
        try:
            size = int(framed[at:line].split(b";")[0], 16)
        except ValueError as e:
            raise BrokenArchive("chunk size") from e
        at = line + 2
        if size == 0:
            return b"".join(body)
        body.append(framed[at : at + size])
        at += size
        if framed[at : at + 2] != b"\r\n":
            raise BrokenArchive("chunk end")
        at += 2


def record(headers: list[tuple[str, str]], content: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(content)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + content + b"\r\n\r\n"


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise BrokenArchive("record header")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        body = content[end + 4 : end + 4 + size]
        if len(body) != size or content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise BrokenArchive("record length")
        yield headers, body
        at = end + 8 + size


def _page_id(value: str | None) -> int | None:
    return None if value in (None, "none") else int(value)


def _name(page_id: int | None, digest: str) -> str:
    """The record id of a page's response: the same wherever it is made, so that revisits can name it."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}").urn


def _records(origin: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    digest = f"sha1:{base32_sha1(payload)}"
    own = [("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("X-Page-ID", "none" if page_id is None else str(page_id)), ("WARC-Payload-Digest", digest)]
    if refers_to is not None:
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{origin}>"), *own, ("WARC-Refers-To", f"<{_name(refers_to, digest)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield record([*headers, ("X-Refers-To-Page-ID", str(refers_to)), ("X-Payload-Length", str(len(payload)))], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    origin = _name(page_id, digest)
    own = [("WARC-Record-ID", f"<{origin}>"), *own]
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(message) <= segment_bytes:
        yield record([("WARC-Type", "response"), *own], message)
        return
    yield record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", "1")], message[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(message), segment_bytes), 2):
        last = at + segment_bytes >= len(message)
        name = f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{origin}/{number}').urn}>"
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", name), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<{origin}>"), ("WARC-Segment-Number", str(number))]
        yield record(headers + [("WARC-Segment-Total-Length", str(len(message)))] * last, message[at : at + segment_bytes])


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, segment_bytes: int = SEGMENT_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """The archives of all pages. Payloads of fewer than ``least_bytes`` bytes are never revisited.

    Written as Parquet, they take the options ``PARQUET``, which give each archive a row group of its own."""
    read = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    read = read.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    ids = read.where(F.octet_length("html") >= least_bytes).select("page_id", "sha1")
    firsts = ids.groupBy("sha1").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    # Written first, and the revisits too, so that both sides of their join are plain shuffles, which Spark cuts at a hot digest.
    scratch = Scratch(pages.sparkSession, "payloads")
    met = ids.join(scratch.write(firsts, "firsts"), "sha1").where(~F.col("page_id").eqNullSafe(F.col("response")))
    again = scratch.write(met.select(F.col("page_id").alias("again"), F.col("sha1").alias("again_sha1"), "response"), "again", drop=("firsts",)).distinct()
    same = F.col("page_id").eqNullSafe(F.col("again")) & (F.col("sha1") == F.col("again_sha1"))
    placed = read.join(again, same, "left").select("page_id", "url", "html", F.col("response").alias("refers_to"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, made, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[bytes] = []

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{made:06d}.warc"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            keys, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for key, address, text, refer in zip(keys, urls, batch.column(2), refers, strict=True):
                origin = uuid.uuid5(uuid.NAMESPACE_URL, f"{task}/{rows}/{key}").urn
                address = "".join((address or "").split()) or "about:blank"
                for made_record in _records(origin, key, address, text.as_py().encode(), refer, segment_bytes):
                    held.append(made_record)
                    size += len(made_record)
                    if size >= archive_bytes:
                        yield archive()
                        held, size, made = [], 0, made + 1
                rows += 1
        if held:
            yield archive()

    return placed.mapInArrow(tasks, ARCHIVE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_segments(archives: DataFrame) -> DataFrame:
    """One row per record: ``origin, segment`` (null: whole record), ``total, kind, page_id, refers_to, digest, size`` (of
    a revisit's payload), ``content``."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, body in parse(content.as_py()):
                    origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]).strip("<>")
                    number, total, length = (h.get(k) for k in ("WARC-Segment-Number", "WARC-Segment-Total-Length", "X-Payload-Length"))
                    rows.append((origin, number and int(number), total and int(total), h["WARC-Type"], _page_id(h.get("X-Page-ID")), _page_id(h.get("X-Refers-To-Page-ID")), h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), length and int(length), body))
                    held += len(body)
                    if held >= BATCH_BYTES:
                        yield _batch(rows, _SEGMENT)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _SEGMENT)

    return archives.select("content").mapInArrow(tasks, SEGMENT)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records: ``kind, page_id, refers_to, digest, size, pieces`` (the contents of the segments, in order).

    Only segmented records meet in a shuffle, by origin; a group is one page (rows repeated with one page id and
    payload have one origin, and as many copies of each segment). An origin whose numbers have gaps or whose
    length is not the total that its last segment gives raises."""
    whole = segments.where(F.col("segment").isNull()).select("kind", "page_id", "refers_to", "digest", "size", F.array("content").alias("pieces"), F.lit(1).alias("copies"))
    pieces = F.array_sort(F.collect_list(F.struct("segment", "total", "page_id", "digest", "content")))
    parts = segments.where(F.col("segment").isNotNull()).groupBy("origin").agg(pieces.alias("p"))
    parts = parts.withColumn("copies", F.size(F.filter("p", lambda x: x["segment"] == 1)))
    parts = parts.withColumn("p", F.filter("p", lambda x, i: i % F.greatest(F.col("copies"), F.lit(1)) == 0))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    length = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["content"]))
    in_order = F.forall(F.transform("p", lambda x, i: x["segment"] == i + 1), lambda x: x)
    good = in_order & last["total"].eqNullSafe(length)
    broken = F.raise_error(F.lit("segments are missing or do not add up to the total length")).cast("array<binary>")
    contents = F.when(good, F.transform("p", lambda x: x["content"])).otherwise(broken)
    none = F.lit(None).cast("bigint")
    joined = parts.select(F.lit("response").alias("kind"), first["page_id"].alias("page_id"), none.alias("refers_to"), first["digest"].alias("digest"), none.alias("size"), contents.alias("pieces"), "copies")
    return whole.unionByName(joined)


def read_pages(archives: DataFrame) -> DataFrame:
    """One row per page: ``page_id, record_type, refers_to, payload_digest, payload_bytes, payload`` (null for revisits).

    The digest of a response is computed from the payload read back, and must be the one in its header."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ids, refers, digests, sizes, copies = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6))
            rows, held = [], 0
            for kind, key, refer, digest, size, pieces, n in zip(kinds, ids, refers, digests, sizes, batch.column(5), copies, strict=True):
                payload = None
                if kind != "revisit":
                    head, _, body = b"".join(pieces.as_py()).partition(b"\r\n\r\n")
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if base32_sha1(payload) != digest:
                        raise BrokenArchive("payload digest")
                    size = len(payload)
                for _ in range(n):
                    rows.append((key, kind, refer, digest, size, payload))
                    held += len(payload or b"")
                    if held >= BATCH_BYTES:
                        yield _batch(rows, _PAGE)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, _PAGE)

    return reassemble(read_segments(archives)).mapInArrow(tasks, PAGE)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive as a file ``folder/<archive>`` that any WARC reader opens; ``archive, bytes`` of what was written.

    Tasks write through the file system that ``folder`` names (a shared one), first under a name of their own,
    so that a task that is run again leaves one whole file."""
    from pyarrow import fs

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = f"{root}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(content.as_buffer())
                system.move(own, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content.as_buffer())], pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(tasks, "archive string, bytes bigint")
