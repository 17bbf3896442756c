"""Stored texts round trip; formats are found, confirmed and carved."""

import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from keystrata.llm import media


def png() -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\x34\xff\x00\x56\xff\xd9"
BMP = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n%%EOF"
SAMPLES = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "audio/wav": media.wav(b"abc"), "image/bmp": BMP, "application/pdf": PDF, "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 99)}


@pytest.mark.parametrize("kind", SAMPLES)
def test_formats(kind):
    search, data = media.automaton(), SAMPLES[kind]
    assert media.sniff(data, search) == (kind, [])
    got = media.sniff(b"some text BM RIFF GIF89a " + data + b" and more", search)
    assert got == (media.UNKNOWN, [(kind, 25, len(data))])
    assert media.sniff(data[:-3], search)[0] in (media.UNKNOWN, "application/pdf")


def test_inspect_corrects_types(spark):
    rows = [(1, "image/png", bytearray(GIF)), (2, "image/gif", bytearray(GIF)), (3, "image/png", None), (4, None, bytearray(b"")), (5, "audio/wav", bytearray(media.wav(media.padded(b"x" + SAMPLES["image/png"]))))]
    df = spark.createDataFrame(rows, "doc_id long, declared string, media binary")
    got = {r["doc_id"]: r for r in media.inspect(df).collect()}
    assert got[1]["detected"] == "image/gif" and got[1]["corrected"] and not got[2]["corrected"]
    assert got[3]["detected"] == got[4]["detected"] == media.UNKNOWN
    assert [x["type"] for x in got[5]["embedded"]] == ["image/png"] and not got[5]["corrected"]


def test_round_trip(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "GIF89a BM RIFF", "long " * 50000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts + texts)], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in media.measured(media.store(df)).collect()}
    for k, t in enumerate(texts + texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_bytes"] == 44 + len(payload) and r["feature"] == got[k % len(texts)]["feature"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert media.measured(media.store(df)).count() == 0


def test_many_headers_take_linear_time():
    search = media.automaton()
    took = []
    for n in (50_000, 100_000):
        start = time.process_time()
        media.sniff(b"PK\x03\x04" + b"xPK\x03\x04" * n, search)
        took.append(time.process_time() - start)
    assert took[1] < 2.5 * took[0] + 0.2


def test_null_media(spark):
    values = spark.createDataFrame([(1, 5, None), (None, None, media.wav(b"\xff" * 576))], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.measured(values).collect()}
    assert got[1]["payload_bytes"] is None and got[1]["feature"] is None and got[None]["payload_bytes"] == 576
