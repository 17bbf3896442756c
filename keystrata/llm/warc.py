"""WARC records as a table of chunks, written and read as streams.

A page becomes one record: ``response`` with its payload (the html in UTF-8; null: empty),
or ``revisit`` without it where another page holds the same payload. Among equal payloads of
at least ``min_bytes`` bytes the page with the largest id is the response (pages without an
id only if there is none with one); repeated rows of that page are equal records.

An archive is a table (record, chunk, chunks, data): the bytes of a record in order, at most
``CHUNK`` in a row, so no writer or reader holds a whole record besides the row it came
from. The reader parses headers and carries digest and length from chunk to chunk; records
of several chunks are brought together by record and sorted by chunk, those of one are read
where they lie. Revisits take length and digest from the response they refer to, which must
agree with their own header.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.batches import map_batches
from keystrata.llm.words import buffers
from keystrata.session import checkpointed

CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = b"1970-01-01T00:00:00Z"  # pages carry no time
_CHUNKS = pa.schema([("record", pa.string()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("data", pa.binary())])
_READ = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("header_digest", pa.string())])


def _record_id(page_id: int | None, digest: str) -> str:
    x = hashlib.sha1(f"{page_id} {digest}".encode()).hexdigest()
    return f"urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:32]}"


def _base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _write(chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, urls, digests, revisits, first = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            data, at = buffers(batch.column(2))
            view, rows, held = memoryview(data), [], 0
            for k, page in enumerate(pages):
                digest = _base32(digests[k])
                body = b"" if revisits[k] else view[at[k] : at[k + 1]]
                name = _record_id(page, digest)
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", urls[k] or "")
                head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisits[k] else b"response"), f"WARC-Record-ID: <{name}>".encode(), b"WARC-Date: " + _DATE,
                        b"WARC-Target-URI: " + url.encode(), f"WARC-Payload-Digest: sha1:{digest}".encode(), f"X-Page-ID: {'' if page is None else page}".encode(),
                        b"Content-Type: application/http;msgtype=response", f"Content-Length: {len(_HTTP) + len(body)}".encode()]
                if revisits[k]:
                    head += [f"WARC-Refers-To: <{_record_id(first[k], digest)}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                start = b"\r\n".join(head) + b"\r\n\r\n" + _HTTP
                total = len(start) + len(body) + 4
                n = -(-total // chunk)
                for i in range(n):  # each chunk from the three parts that it overlaps
                    lo, hi = i * chunk, min((i + 1) * chunk, total)
                    cut = lambda part, offset: bytes(part[max(0, lo - offset) : max(0, hi - offset)])  # noqa: B023, E731
                    rows.append((name, i, n, cut(start, 0) + cut(body, len(start)) + cut(b"\r\n\r\n", len(start) + len(body))))
                    held += hi - lo
                    if held > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)

    return run


def to_chunks(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The archive's rows for pages (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    equal = p.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # Written first, so that the planner knows its size when it chooses the join.
    equal = checkpointed(equal.where("n > 1").select(F.col("digest").alias("same"), "first"))
    joined = p.join(equal, p["digest"] == equal["same"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return map_batches(joined.select("page_id", "url", "html", "digest", revisit.alias("revisit"), "first"), _write(chunk), "record string, chunk long, chunks long, data binary")


class _Parser:
    """One record, fed chunk by chunk."""

    def __init__(self, record: str):
        self.record, self.head, self.fields, self.left, self.http = record, b"", None, 0, None
        self.digest, self.size = hashlib.sha1(), 0

    def feed(self, data: memoryview) -> None:
        if self.fields is None:
            self.head += bytes(data)
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].split(b"\r\n")
            if not lines[0].startswith(b"WARC/1."):
                raise ValueError(f"{self.record}: not a WARC record")
            self.fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
            self.left = int(self.fields["content-length"])
            data, self.head, self.http = memoryview(self.head)[end + 4 :], b"", b""
        data = data[: self.left]
        self.left -= len(data)
        if self.http is not None:
            self.http += bytes(data[: 1 << 16])
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            data, self.http = data[end + 4 - (len(self.http) - min(len(data), 1 << 16)) :], None
        self.digest.update(data)
        self.size += len(data)

    def row(self) -> tuple:
        if self.fields is None or self.left or self.http is not None:
            raise ValueError(f"{self.record}: the record is cut short")
        f = self.fields
        kind, page = f["warc-type"], f.get("x-page-id", "")
        target = f["warc-refers-to"].strip("<>") if kind == "revisit" else None
        return (self.record, int(page) if page else None, kind, target, self.size, base64.b32encode(self.digest.digest()).decode(), f["warc-payload-digest"].removeprefix("sha1:"))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser, place = None, 0
    for batch in batches:
        rows = []
        for record, chunk, chunks, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if chunk == 0:
                parser, place = _Parser(record), 0
            elif chunk == place - 1 and parser is not None and parser.record == record:
                continue  # a repeated page's chunk again
            if parser is None or parser.record != record or chunk != place:
                raise ValueError(f"{record}: chunk {chunk} out of place")
            parser.feed(memoryview(data.as_buffer()))
            place += 1
            if place == chunks:
                rows.append(parser.row())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


_READ_DDL = "record string, page_id long, record_type string, target string, payload_bytes long, payload_digest string, header_digest string"


def read_records(chunks: DataFrame) -> DataFrame:
    """(record, page_id, record_type, target, payload_bytes, payload_digest, header_digest)
    of each record of an archive, computed from its bytes."""
    single = map_batches(chunks.where("chunks = 1"), _read, _READ_DDL)
    # Copies of a record (repeated rows) share an id; a count per chunk lets each be read once.
    several = chunks.where("chunks > 1").groupBy("record", "chunk").agg(F.first("chunks").alias("chunks"), F.first("data").alias("data"), F.count("*").alias("copies"))
    several = checkpointed(several)
    copies = several.where("chunk = 0").select("record", "copies")
    streamed = map_batches(several.repartition("record").sortWithinPartitions("record", "chunk").select("record", "chunk", "chunks", "data"), _read, _READ_DDL)
    streamed = streamed.join(copies, "record").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "__copy")
    return single.unionByName(streamed)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact): revisits
    with length and digest of the response they refer to; intact: digests agree."""
    responses = records.where("record_type = 'response'").select(F.col("record").alias("target"), F.col("page_id").alias("r_page"), F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest")).dropDuplicates(["target"])
    revisits = records.where("record_type = 'revisit'").select("page_id", "target", "header_digest").join(responses, "target", "left")
    out = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), (F.col("payload_digest") == F.col("header_digest")).alias("intact"))
    return out.union(revisits.select("page_id", F.col("r_bytes"), F.col("r_digest"), F.lit("revisit"), "r_page", F.coalesce(F.col("r_digest") == F.col("header_digest"), F.lit(False))))


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes pages as an archive in the shared folder and reads it back."""
    archive = checkpointed(to_chunks(pages, min_bytes, chunk))
    return resolved(checkpointed(read_records(archive)))
