"""Files read by byte ranges against the same files read whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from keystrata.sources import files, ranges, repository


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("ranges"), random.Random(4)
    data = bytearray(rng.randbytes(300_000))
    for k in range(400):  # strings all over, also across any border
        at = rng.randrange(len(data) - 100)
        data[at : at + 40] = (b"OpenSSL 1.1.%d TLS_AES_128_GCM_SHA256 " % k)[:40]
    contents = {
        "bin/lib crypto.so": b"\x7fELF" + bytes(data), "bin/small": b"MZ\n\n\n" + b"\x00" * 50, "zero": b"\x00" * 70_000 + b"printable tail",
        "one.txt": b"x", "ends.txt": b"a\n\nb\n", "crlf.py": b"import hashlib\r\nh = hashlib.md5(x)\r\n" * 3000,
        "nolines": b"abcdefgh" * 20_000, "node_modules/x.js": b"left out", "blank": b"\n" * 5000,
    }
    for name, content in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root), {k: v for k, v in contents.items() if "node_modules" not in k}


@pytest.mark.parametrize("size", [None, 4096, 700])
def test_lines(spark, tree, size):
    root, contents = tree
    got = {}
    for r in ranges.read_lines(spark, root, range_bytes=size).collect():
        got.setdefault(r["path"], []).append((r["line"], r["byte_offset"], bytes(r["value"])))
    assert set(got) == set(contents)
    for path, content in contents.items():
        lines, at, want = content.split(b"\n"), 0, []
        for k, line in enumerate(lines if lines[-1] else lines[:-1]):
            want.append((k + 1, at, line))
            at += len(line) + 1
        assert sorted(got[path]) == want, path


@pytest.mark.parametrize("size", [None, 4096, 700])
def test_strings_and_formats(spark, tree, size):
    root, contents = tree
    found = ranges.scan_ranges(spark, root, range_bytes=size)
    whole = files.scan_files(spark, root)
    want = files.printable_strings(whole.select("path", "content"))
    key = ["path", "position", "string", "byte_offset"]
    assert sorted(map(tuple, ranges.range_strings(found).select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    kinds = ["path", "language", "binary_format"]
    got = files.with_binary_format(files.with_language(ranges.range_files(found)))
    assert sorted(map(tuple, got.select(kinds).collect())) == sorted(map(tuple, files.with_binary_format(files.with_language(whole)).select(kinds).collect()))
    assert {r["path"]: r["lines"] for r in got.collect()} == {k: len(v.split(b"\n")) - v.endswith(b"\n") for k, v in contents.items()}


SOURCES = {
    "a.py": ("python", "import hashlib\n" + "x = 1\n" * 300 + "h = hashlib.new(\n    'md5',\n    data)\n" + "# AES\n" * 200 + 'D = """\nAES.new(k)\n"""\n' + "k = RSA.generate(2048)\n" * 50),
    "b.js": ("javascript", "const c = require('crypto');\n" + "let a = 1;\n" * 500 + "c.createHash('sha1');\nconst {\n x,\n y\n} = require('jsonwebtoken')\n" * 20),
    "c.java": ("java", "import javax.crypto.Cipher;\n" + "// AES\nCipher c = Cipher.getInstance(\"AES/GCM/NoPadding\");\n" * 120),
    "d.c": ("c", "#include <openssl/evp.h>\n" + "int é = 0; /* DES */\nRSA_generate_key_ex(r, 1024, e, NULL);\nEVP_aes_256_gcm()\n" * 90 + "-----BEGIN\nRSA PRIVATE KEY-----\n" * 40),
}


@pytest.mark.parametrize("chunk, overlap", [(1 << 20, 1 << 10), (1500, 600), (700, 400)])
def test_chunks_of_source_as_whole_files(spark, tmp_path, chunk, overlap):
    for name, (_, text) in SOURCES.items():
        (tmp_path / name).write_text(text)
    whole = spark.createDataFrame([(n, lang, t) for n, (lang, t) in SOURCES.items()], "path string, language string, text string")
    lines = ranges.read_lines(spark, str(tmp_path), range_bytes=1000)
    chunks = files.with_language(ranges.source_chunks(lines, chunk, overlap).withColumn("name", F.col("path")).withColumn("content", F.lit(None).cast("binary")))
    key = ["finding_id", "emit_seq", "location.file_path", "location.start_line", "raw_symbol", "discovery_method", "suspected_algorithm", "key_size_hint", "confidence_score"]
    got = sorted(map(str, ranges.scan_source_chunks(chunks).select(key).collect()))
    want = sorted(map(str, repository.scan_repository(whole).select(key).collect()))
    assert got == want and len(want) > 500


def test_large_files_in_small_tasks(spark, tmp_path):
    """A file of many ranges, none of which is read whole."""
    unit = os.urandom(1 << 16).replace(b"\n", b"\x00") + b"\nlibcrypto string here\n"
    with open(tmp_path / "large.bin", "wb") as f:
        for _ in range(1600):  # 100 MiB
            f.write(unit)
    found = ranges.scan_ranges(spark, str(tmp_path), range_bytes=4 << 20)
    marks = ranges.range_strings(found).where("string = 'libcrypto string here'").selectExpr("count(*) as n", "max(byte_offset) as top").first()
    assert (marks["n"], marks["top"]) == (1600, len(unit) * 1599 + (1 << 16) + 1)
    assert found.where("string is null").count() >= 20
