"""Media columns: texts stored as 8-bit samples, and signature sniffing of binary columns.

``store`` packs a text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as an
8-bit mono PCM WAV. ``inspect`` reads binary values back: an Aho-Corasick automaton finds
the magic bytes of all formats in one scan, a validator per format then confirms structure
and length, the value's declared type is corrected by what stands at its beginning, and
confirmed media further inside are carved out as (type, start, length). A value that starts
with no confirmed format keeps type ``application/octet-stream``.

Null texts count as empty; equal texts give equal values. Nulls among media are inspected
as empty values. Every byte is stored and scanned.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.batches import map_batches
from keystrata.llm.words import buffers

UNIT = 576
RATE = 8000
UNKNOWN = "application/octet-stream"


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def wav(samples: bytes) -> bytes:
    """A WAV of 8-bit mono samples."""
    pad = len(samples) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + b"\0" * pad


def wav_samples(data: bytes) -> bytes:
    """The samples of a valid WAV."""
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _png(d: bytes, at: int) -> int:
    place = at + 8
    while place + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, place)
        end = place + 12 + size
        if end > len(d) or zlib.crc32(d[place + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return 0
        if place == at + 8 and kind != b"IHDR":
            return 0
        if kind == b"IEND":
            return end - at
        place = end
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    place = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)
    while place < len(d):
        mark = d[place]
        if mark == 0x3B:
            return place + 1 - at
        if mark == 0x2C and place + 10 < len(d):
            flags = d[place + 9]
            place += 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1
        elif mark == 0x21:
            place += 2
        else:
            return 0
        while place < len(d) and d[place]:
            place += d[place] + 1
        place += 1
    return 0


def _jpeg(d: bytes, at: int) -> int:
    place = at + 2
    while place + 4 <= len(d):
        if d[place] != 0xFF:
            return 0
        mark = d[place + 1]
        if mark == 0xD9:
            return place + 2 - at
        if not 0xC0 <= mark <= 0xFE or 0xD0 <= mark <= 0xD8:
            return 0
        place += 2 + struct.unpack_from(">H", d, place + 2)[0]
        if mark == 0xDA:
            while True:  # entropy-coded data up to the next marker
                place = d.find(b"\xff", place)
                if place < 0 or place + 1 >= len(d):
                    return 0
                if d[place + 1] == 0 or 0xD0 <= d[place + 1] <= 0xD7:
                    place += 2
                else:
                    break
    return place + 2 - at if d[place : place + 2] == b"\xff\xd9" else 0


def _wav(d: bytes, at: int) -> int:
    if d[at + 8 : at + 12] != b"WAVE":
        return 0
    end, place, seen = at + 8 + struct.unpack_from("<I", d, at + 4)[0], at + 12, set()
    if end > len(d):
        return 0
    while place + 8 <= end:
        kind, size = struct.unpack_from("<4sI", d, place)
        seen.add(kind)
        place += 8 + size + (size & 1)
    return end - at if place == end and {b"fmt ", b"data"} <= seen else 0


def _bmp(d: bytes, at: int) -> int:
    if at + 30 > len(d):
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", d, at + 2)
    if zero or header not in (12, 40, 52, 56, 108, 124) or not 14 + header <= offset <= size or at + size > len(d):
        return 0
    return size


def _pdf(d: bytes, at: int) -> int:
    nxt = d.find(b"%PDF-", at + 5)
    end = d.rfind(b"%%EOF", at, nxt if nxt > 0 else len(d))
    return end + 5 - at if end > 0 and d.find(b" obj", at, end) > 0 else 0


def _zip(d: bytes, at: int, known: dict[str, int] | None = None) -> int:
    """known: where the next end record is, so that many headers before it look for it once."""
    known = {} if known is None else known
    if known.get("end", -1) < at:
        known["end"] = d.find(b"PK\x05\x06", at) % (len(d) + 1)  # none: the data's end
    end = known["end"]
    if end + 22 > len(d):
        return 0
    size, offset, note = struct.unpack_from("<IIH", d, end + 12)
    if at + offset + size != end or d[at + offset : at + offset + 4] not in (b"PK\x01\x02", b"PK\x05\x06"):
        return 0
    return end + 22 + note - at if end + 22 + note <= len(d) else 0


def _gzip(d: bytes, at: int) -> int:
    if d[at + 3 : at + 4] and d[at + 3] & 0xE0:
        return 0
    inflate, place = zlib.decompressobj(31), at
    try:
        while place < len(d) and not inflate.eof:
            inflate.decompress(d[place : place + 65536], 1 << 20)
            while inflate.unconsumed_tail:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            place += 65536
    except zlib.error:
        return 0
    return min(place, len(d)) - len(inflate.unused_data) - at if inflate.eof else 0


def _ogg(d: bytes, at: int) -> int:
    place = at
    while d[place : place + 4] == b"OggS" and place + 27 <= len(d):
        count = d[place + 26]
        table = d[place + 27 : place + 27 + count]
        end = place + 27 + count + sum(table)
        if len(table) < count or end > len(d):
            return 0
        place = end
    return place - at


#: (magic, type, validator): a validator gives the length of what begins at a place, or 0.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _wav),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
)


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), (k, len(magic)))
    out.make_automaton()
    return out


def sniff(data: bytes, search: ahocorasick.Automaton) -> tuple[str, list[tuple[str, int, int]]]:
    """(type at the beginning, media further inside). Inside a container only what lies in
    its payload counts as embedded; media inside embedded media do not."""
    kind, found, until, known = UNKNOWN, [], 0, {}
    for last, (k, size) in search.iter(data.decode("latin-1")):
        start = last - size + 1
        if start < until:
            continue
        validator = FORMATS[k][2]
        length = _zip(data, start, known) if validator is _zip else validator(data, start)
        if not length:
            continue
        if start == 0:
            kind = FORMATS[k][1]
            if kind != "audio/wav":  # compressed or structured: its parts are its own
                until = length
        else:
            found.append((FORMATS[k][1], start, length))
            until = start + length
    return kind, found


def features(samples: bytes, embedded: list[tuple[str, int, int]]) -> str:
    """Length in units, mean, deviation, rate of sign changes around the middle, entropy in
    bits, and what is embedded."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    total, squares = int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    mean = total / len(x)
    deviation = max(squares / len(x) - mean * mean, 0.0) ** 0.5
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    inside = "+".join(f"{kind}@{start}:{length}" for kind, start, length in embedded)
    return f"units={len(x) // UNIT};mean={mean:.3f};sd={deviation:.3f};crossings={crossings};bits={-(p * np.log2(p)).sum():.3f};embedded={inside or '-'}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared, media): every text as a WAV."""

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(1))
            media = [wav(padded(data[at[k] : at[k + 1]].tobytes())) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(["audio/wav"] * batch.num_rows), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return map_batches(docs.select(id_col, text_col), run, "doc_id long, n_bytes long, declared string, media binary")


def inspect(values: DataFrame) -> DataFrame:
    """(doc_id, declared, detected, corrected, embedded) for values (doc_id, declared, media)."""

    def run(batches):
        search = automaton()
        for batch in batches:
            out = []
            for declared, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kind, inside = sniff(data or b"", search)
                out.append((kind, declared != kind, [{"type": t, "start": s, "length": n} for t, s, n in inside]))
            kinds, changed, inside = zip(*out) if out else ((), (), ())
            shape = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(kinds, pa.string()), pa.array(changed, pa.bool_()), pa.array(inside, shape)], names=["doc_id", "declared", "detected", "corrected", "embedded"])

    return map_batches(values.select("doc_id", "declared", "media"), run, "doc_id long, declared string, detected string, corrected boolean, embedded array<struct<type:string,start:long,length:long>>")


def measured(values: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, detected) of stored texts, all from the stored bytes; null media have nulls."""

    def run(batches):
        search = automaton()
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                if data is None:
                    out.append((None,) * 7)
                    continue
                kind, inside = sniff(data, search)
                if kind != "audio/wav":
                    raise ValueError(f"a stored text was read back as {kind}")
                payload = wav_samples(data)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, inside), kind))
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected"])

    return map_batches(values.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected string")
