"""Column functions against plain Python."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from keystrata.functions import ids, naming, scoring, text
from keystrata.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_uuid_v5(spark):
    names = ["", "a", "path:x|line:1", "é€😀"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    for row in df.select("s", ids.uuid_v5(ids.ASSET_NAMESPACE, F.col("s")).alias("u")).collect():
        assert row.u == str(uuid.uuid5(ids.ASSET_NAMESPACE, row.s))


@pytest.mark.parametrize("regex", [
    r"(?iUd)-----BEGIN\s+CERTIFICATE-----", r"(?iUd)\baes\b", r'(?iUd)"alg"\s*:\s*"(HS256|none)"', r"(?md)^\s*import\s+([\w.]+)\s*;",
])
def test_text_hits_equal_finditer(spark, regex):
    r = random.Random(7)
    parts = ["-----BEGIN CERTIFICATE-----", "-----BEGIN\n\n CERTIFICATE-----", "aes", " ", "\n", "AES_", '"alg": "HS256"', '"alg"\n:"none"',
             "import a.b;", "\n\nimport c ;", "xé", "\r"]
    texts = ["".join(r.choice(parts) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for row in text.text_hits(df, {"a": regex}).orderBy("id", "ordinal").collect():
        got.setdefault(row.id, []).append((row.line, row.place, row.symbol))
    python = re.compile(regex.replace("(?iUd)", "(?i)").replace("(?md)", "(?m)"))
    for i, body in enumerate(texts):
        want = [(body[:m.start()].count("\n") + 1, m.start(), m.group(0)) for m in python.finditer(body)]
        assert got.get(i, []) == want, repr(body)


def test_snippet(spark):
    body = "\n".join(f"line {i} " + "x" * 60 for i in range(1, 8))
    lines = text.text_lines(F.lit(body))
    assert one(spark, text.snippet(lines, F.lit(1))) == "\n".join(body.split("\n")[:3])[:200] + "..."
    assert one(spark, text.snippet(text.text_lines(F.lit("a\nb\nc")), F.lit(3))) == "a\nb\nc"


def test_norm_path(spark):
    assert one(spark, text.norm_path(F.lit(" ./Src\\A.py "))) == "src/a.py"
    assert one(spark, text.norm_path(F.lit("././a"))) == "./a"


def test_printable_strings_offsets(spark):
    r = random.Random(2)
    blobs = [bytes(r.choice([0, 1, 65, 66, 97, 126, 127, 200]) for _ in range(3000)) for _ in range(4)] + [b"", b"short", b"exactly8"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "id int, content binary")
    got = {(x.id, x.byte_offset, x.string) for x in files.printable_strings(df, 4).collect()}
    want = {(i, m.start(), m.group(0).decode()) for i, b in enumerate(blobs) for m in re.finditer(rb"[\x20-\x7e]{4,}", b)}
    assert got == want


def test_names(spark):
    parse = lambda s: tuple(one(spark, naming.parse_algorithm_name(F.lit(s))))
    assert parse("AES_256_GCM") == ("AES", 256, "GCM")
    assert parse("aes128cbc") == ("AES", 128, "CBC")
    assert parse("AES256-GCM") == ("AES256-GCM", None, None)
    assert parse("RSA-1000") == ("RSA-1000", None, None)
    assert parse("sha384") == ("SHA-384", None, None)
    evp = lambda s: one(spark, naming.parse_evp(F.lit(s)))
    assert tuple(evp("EVP_aes_192_ctr")) == ("AES-192-CTR", 192, "CTR")
    assert tuple(evp("EVP_sha3_256")) == ("SHA-3", None, None)
    assert evp("EVP_MD_CTX") is None and evp("sha256") is None
    assert one(spark, naming.key_from_symbol(F.lit("generate 1024"), F.lit("AES"))) is None
    assert one(spark, naming.key_from_symbol(F.lit("generate(1024)"), F.lit("ECDH"))) == 1024
    assert one(spark, naming.canonical_library(F.lit("my-bouncycastle-fork"))) == "BouncyCastle"


@pytest.mark.parametrize("score,level", [(0.85, "VERY_HIGH"), (0.8499, "HIGH"), (0.70, "HIGH"), (0.45, "MEDIUM"), (0.2, "LOW"), (0.1999, "VERY_LOW")])
def test_confidence_levels(spark, score, level):
    assert one(spark, scoring.confidence_level(F.lit(score))) == level


@pytest.mark.parametrize("score,tier", [(80, "CRITICAL"), (79.9, "HIGH"), (60, "HIGH"), (30, "MEDIUM"), (29.9, "LOW"), (-5, "LOW"), (200, "CRITICAL")])
def test_severities(spark, score, tier):
    assert one(spark, scoring.severity(F.lit(score))) == tier


def test_share_and_nulls(spark):
    assert one(spark, scoring.share(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, scoring.share(F.lit(9), F.lit(3))) == 1.0
    assert one(spark, scoring.clamp(F.lit(None).cast("double"), 0, 100)) is None
