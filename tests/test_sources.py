"""Files on disk through scanning, analysis and export."""

import json

import pytest
from pyspark.sql import functions as F

from keystrata.operators import components, merge, quality
from keystrata.operators.normalize import normalize
from keystrata.operators.timeline import TimelineConfig
from keystrata.plans import inventory
from keystrata.schemas import FINDINGS, STAGES
from keystrata.sources import binary, container, files, repository, tables

PY = b"""import hashlib
from Crypto.PublicKey import (RSA,
    DSA)
import ssl as tls, json

KEY = RSA.generate(
    1024)
digest = hashlib.new("md5", data)
# AES and DES in a comment
PEM = '''-----BEGIN
RSA PRIVATE KEY-----'''
h = outer(hashlib.sha512(x), Cipher(algorithms.AES(k), modes.GCM(iv)))
def new(self): pass
"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for name, content in {
        "app/main.py": PY, "app/node_modules/x.js": b"crypto.createHash('md5')", "app/lib.min.js": b"AES",
        "app/big.c": b"/* AES */\n" + b" " * 5000, "app/a.kt": b"// none\r\nval c = Cipher.getInstance(\"DESede\")\r\n",
        "app/bad.py": b"x = 'AES \xff\xfe'\n", "bin/tool.py": b"\x7fELF\x02AES", "blank.py": b" \n \n", "notes.txt": b"RSA",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_listing_limits_and_languages(spark, tree):
    found = files.with_language(files.scan_files(spark, tree, max_bytes=4000))
    got = {r.path: r.language for r in found.select("path", "language").collect()}
    assert got == {"app/main.py": "python", "app/a.kt": "java", "app/bad.py": "python", "bin/tool.py": "binary",
                   "blank.py": "python", "notes.txt": "unknown"}
    row = files.scan_counters(spark, tree, max_bytes=4000).first()
    assert (row.files_discovered, row.files_skipped_too_large, row.directories_visited) == (7, 1, 3)
    plan = files.scan_files(spark, tree, max_bytes=4000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4000)" in plan
    listing = files.list_files(spark, tree).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing


def test_text_reading(spark, tree):
    texts = {r.path: r.text for r in files.with_text(files.scan_files(spark, tree)).select("path", "text").collect()}
    assert texts["app/bad.py"].startswith("x = 'AES �") and "\r" not in texts["app/a.kt"]


def test_repository_scan(spark, tree):
    src = files.with_language(files.with_text(files.scan_files(spark, tree))).select("path", "language", "text")
    rows = repository.scan_repository(src).collect()
    main = [r for r in rows if r.location.file_path == "app/main.py"]
    imports = {(r.location.start_line, r.raw_symbol) for r in main if r.discovery_method == "IMPORT_ANALYSIS"}
    assert imports == {(1, "import hashlib"), (2, "from Crypto.PublicKey import RSA, DSA"), (4, "import ssl as tls")}
    calls = {(r.raw_symbol, r.key_size_hint, (r.raw_parameters or {}).get("algorithm_arg")) for r in main if r.discovery_method == "AST"}
    assert calls == {("RSA.generate", 1024, None), ("hashlib.new", None, "md5"), ("hashlib.sha512", None, None), ("Cipher", None, None),
                     ("algorithms.AES", None, None), ("modes.GCM", None, None)}
    pem = [r for r in main if r.artifact_category == "KEY_MATERIAL"]
    assert [(r.location.start_line, r.raw_symbol, r.suspected_algorithm) for r in pem] == [(10, "-----BEGIN\nRSA PRIVATE KEY-----", "RSA")]
    comment = {r.suspected_algorithm: r.confidence_score for r in main if r.location.start_line == 9}
    assert comment == {"AES": 0.22, "DES": 0.22}
    java = [r for r in rows if r.location.file_path == "app/a.kt"]
    assert [(r.suspected_algorithm, r.location.start_line) for r in java if r.discovery_method == "API_CALL"] == [("DES", 2)]
    for path in {r.location.file_path for r in rows}:
        order = [r.emit_seq for r in rows if r.location.file_path == path]
        assert len(order) == len(set(order))
    assert len({r.finding_id for r in rows}) == len(rows)


def test_run_is_repeatable_and_consistent(spark, tree, tmp_path):
    src = files.with_language(files.with_text(files.scan_files(spark, tree))).select("path", "language", "text")
    out = inventory.run(src, x=10.0, y=2.0, z=11.0)
    ids = sorted(r.asset_id for r in out["assets"].select("asset_id").collect())
    again = sorted(r.asset_id for r in inventory.run(src.repartition(5))["assets"].select("asset_id").collect())
    assert ids == again and quality.repeated_ids(out["assets"]).count() == 0
    total = out["assets"].count()
    assert total == out["risk"].count() == out["timeline"].count() == out["recommendations"].count() == out["components"].count()
    assert out["evidence"].count() == out["findings"].count() == out["normalization_stats"].first().raw_findings_count
    sizes = {r.dimension: r.n for r in out["asset_distributions"].groupBy("dimension").agg(F.sum("n").alias("n")).collect()}
    assert set(sizes.values()) == {total}
    assert {r.y_migration_time_years for r in out["timeline"].where("applicable").collect()} == {2.0}
    assert quality.finding_problems(out["findings"]).count() == 0 and quality.risk_problems(out["risk"]).count() == 0
    assert inventory.scan_status(out["findings"].limit(1)).first().status == "PARTIAL"

    twice = inventory.assessed(out["assets"].unionAll(out["assets"]), None, TimelineConfig())
    assert twice.count() == 2 * total == 2 * out["index"].count() == 2 * out["inventory"].count()
    for bad in ({"x": -1.0}, {"y": float("nan")}, {"z": float("inf")}):
        with pytest.raises(ValueError):
            inventory.analyse(out["findings"], **bad)
    given = out["assets"].select("asset_id").limit(2).selectExpr(
        "asset_id", "-1D AS migration_time_years", "3D AS quantum_arrival_years", "CAST(NULL AS DOUBLE) AS protected_lifetime_years",
        "true AS hndl_sensitive", "CAST(NULL AS DATE) AS assessment_date")
    mixed = inventory.analyse(out["findings"], y=4.0, inputs=given)
    assert mixed["invalid_durations"].count() == 2 and mixed["timeline"].count() == total
    assert {r.y_migration_time_years for r in mixed["timeline"].where("applicable").collect()} == {4.0}

    header = components.document_header(spark).selectExpr(
        "*", "true AS has_metadata", "true AS has_tools", "true AS has_components")
    problems = quality.validate_components(header, out["components"], "name")
    assert quality.validity(problems).first().is_valid

    tables.write_csv(out["inventory"], str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == total and len(back.columns) == 16
    tables.write_json(tables.component_json(out["components"]), str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(lines) == total and all(c["type"] == "cryptographic-asset" and c["bom-ref"] for c in lines)
    assert all(v is not None for c in lines for v in c["cryptoProperties"].get("algorithmProperties", {}).values())
    tables.write_xml(out["components"], str(tmp_path / "xml"))
    xml = spark.read.format("xml").option("rowTag", "component").load(str(tmp_path / "xml"))
    assert xml.count() == total and "_bom-ref" in xml.columns
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "xml")).collect())
    assert 'xmlns="http://cyclonedx.org/schema/bom/1.6"' in text and 'serialNumber="urn:uuid:' in text

    every = components.with_occurrences(out["components"], out["evidence"], size=2)
    lists = every.select("bom_ref", F.size("evidence").alias("n")).collect()
    assert max(r.n for r in lists) == 2 and sum(r.n for r in lists) == out["evidence"].count()
    assert {r.bom_ref for r in lists} == {r.bom_ref for r in out["components"].select("bom_ref").collect()}
    chunks = merge.evidence_chunks(out["evidence"], 3).select(F.size("supporting_findings").alias("n")).collect()
    assert max(r.n for r in chunks) == 3 and sum(r.n for r in chunks) == out["evidence"].count()
    tables.write_document(components.document_header(spark), every, str(tmp_path / "document"))
    head = spark.read.json(str(tmp_path / "document" / "header")).first()
    assert head.bomFormat == "CycloneDX" and head.metadata.tools.components[0].name == "keystrata"
    assert spark.read.json(str(tmp_path / "document" / "components")).count() == len(lists)
    tables.write_table(out["findings"], str(tmp_path / "findings"))
    assert tables.read_table(spark, str(tmp_path / "findings"), FINDINGS).count() == out["findings"].count()
    assert STAGES["assets"]


def test_empty_input(spark):
    none = spark.createDataFrame([], "path string, language string, text string")
    out = inventory.run(none)
    assert out["assets"].count() == 0 and out["risk_report"].first().overall_risk_score == 0.0
    assert out["normalization_stats"].first().merge_ratio == 0.0


def test_library_paths_as_forms_only_on_request(spark):
    row = {f.name: None for f in FINDINGS.fields} | {
        "finding_id": "a", "emit_seq": 1, "raw_symbol": "#include <openssl/evp.h>", "artifact_category": "LIBRARY", "library_hint": "OpenSSL",
        "confidence_score": 0.7, "discovery_method": "IMPORT_ANALYSIS"}
    df = spark.createDataFrame([tuple(row[f.name] for f in FINDINGS.fields)], FINDINGS)
    assert normalize(df).first().algorithm == "Library: OpenSSL"
    assert normalize(df, forms_in_libraries=True).first().algorithm == "openssl"


def test_container_and_binary(spark, tmp_path):
    root = tmp_path / "fs"
    for name, content in {
        "usr/lib/libssl.so.1.1.1k": b"x", "var/lib/dpkg/status": b"Package: openssl\nVersion: 1\n\nPackage: bash\nVersion: 2\n",
        "etc/ssl/c.crt": b"-----BEGIN CERTIFICATE-----\n", "opt/libssl.so": b"x",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    src = files.with_text(files.scan_files(spark, str(root), exclude=[]))
    rows = container.scan_container(src, container.container_context("img")).collect()
    assert sorted((r.raw_symbol, r.discovery_method) for r in rows) == sorted(
        [("libssl.so.1.1.1k", "LIBRARY_DETECTION")] * 9 + [("openssl==1", "PACKAGE_INSPECTION")] * 9
        + [("-----BEGIN CERTIFICATE-----", "STRING_ANALYSIS"), ("-----BEGIN CERTIFICATE-----", "REGEX")])
    assert container.scan_shared_libs(src, container.container_context(), most=3).count() == 3
    assert all(r.container_context.image_reference == "img" for r in rows)

    blob = b"\x7fELF" + bytes(8) + b"OpenSSL 1.1.1k\x00RSA_sign\x00TLS_RSA_WITH_NULL_MD5\x00-----BEGIN PUBLIC KEY-----\x00AES-256-GCM cipher\x00"
    bins = spark.createDataFrame([("tool", bytearray(blob))], "path string, content binary")
    strings = files.printable_strings(files.with_binary_format(bins), 8)
    symbols = spark.createDataFrame([("tool", s, None, "ELF") for s in ("RSA_sign", "RSA_new", "AES_encrypt", "AES_encrypt", "zlib")],
                                    "path string, symbol string, dll string, binary_format string")
    found = binary.scan_binaries(strings, symbols)
    got = {(r.raw_symbol, r.discovery_method, round(r.confidence_score, 4)) for r in found.collect()}
    assert got == {
        ("RSA_sign", "SYMBOL_INSPECTION", 0.95), ("RSA_new", "SYMBOL_INSPECTION", 0.88), ("AES_encrypt", "SYMBOL_INSPECTION", 0.93),
        ("OpenSSL 1.1.1k", "STRING_ANALYSIS", 0.9), ("TLS_RSA_WITH_NULL_MD5", "STRING_ANALYSIS", 0.72), ("TLS_RSA_WITH_NULL_MD5", "STRING_ANALYSIS", 0.44),
        ("-----BEGIN PUBLIC KEY-----", "STRING_ANALYSIS", 0.9), ("AES-256-GCM", "STRING_ANALYSIS", 0.579)}
    assets, _ = merge.build_assets(normalize(found))
    assert assets.where("binary_format = 'ELF'").count() == assets.count() > 0


def test_document_problems(spark):
    bad = spark.createDataFrame([("Other", "1.5", 0, "urn:uuid:x", False, False, False)],
                                "bom_format string, spec_version string, version int, serial_number string, has_metadata boolean, has_tools boolean, has_components boolean")
    rules = {r.rule for r in quality.validate_header(bad).collect()}
    assert rules == {"bom_format_wrong", "spec_version_wrong", "version_below_one", "serial_number_form", "metadata_missing", "components_missing"}
    empty = bad.selectExpr("CAST(NULL AS STRING) AS bom_format", "CAST(NULL AS STRING) AS spec_version", "CAST(NULL AS INT) AS version",
                           "CAST(NULL AS STRING) AS serial_number", "true AS has_metadata", "false AS has_tools", "true AS has_components")
    assert {r.rule for r in quality.validate_header(empty).collect()} == {"bom_format_missing", "spec_version_missing", "version_missing", "tools_missing"}


def _python(spark, text):
    return spark.createDataFrame([("a.py", "python", text)], "path string, language string, text string")


def _calls(spark, text):
    return [(r.raw_symbol, r.key_size_hint, r.location.start_line) for r in repository.scan_repository(_python(spark, text)).where("discovery_method = 'AST'").orderBy("emit_seq").collect()]


def test_long_and_deep_calls(spark):
    assert _calls(spark, "RSA.generate(2048, '" + "x" * 1_000_000 + "')") == [("RSA.generate", 2048, 1)]
    assert _calls(spark, "RSA.generate(key=f(" + "(" * 5000 + ")" * 5000 + "), bits=1)") == [("RSA.generate", None, 1)]
    deep = "rsa.generate_private_key(public_exponent=a(b(c(d(e(f(g(h(i(j(1)))))))))), key_size=1024)"
    assert _calls(spark, deep) == [("rsa.generate_private_key", 1024, 1)]
    assert _calls(spark, "rsa.generate_private_key(x=')', y='a, b', key_size=4096)") == [("rsa.generate_private_key", 4096, 1)]
    assert _calls(spark, "rsa.generate_private_key(key_size=4096") == [("rsa.generate_private_key", None, 1)]
    assert _calls(spark, "a." * 20_000 + "x\nRSA.generate(1024)") == [("RSA.generate", 1024, 2)]
    many = _calls(spark, "RSA.generate(\n 2048)\n" * 10_000)
    assert len(many) == 10_000 and many[-1] == ("RSA.generate", 2048, 19_999)


def test_strings_and_comments_hold_no_calls(spark):
    text = '"""use hashlib.md5(x)\nimport hashlib\nnever"""\nimport ssl  # import hmac\nx = 1  # hashlib.md5(y)\ns = "hashlib.sha1(z)"\nhashlib.sha256(a)  # end\n'
    assert _calls(spark, text) == [("hashlib.sha256", None, 7)]
    found = repository.scan_imports(_python(spark, text)).collect()
    assert [(r.raw_symbol, r.location.start_line) for r in found] == [("import ssl", 4)]


def test_many_hits_in_a_line(spark):
    text = "x\n" + "AES " * 200_000 + "\nMD5\n" + "import hashlib, " + ", ".join(["ssl"] * 300)
    rows = repository.scan_repository(_python(spark, text)).select("emit_seq", "location.start_line", "discovery_method", F.length("location.snippet").alias("n"))
    got = rows.agg(F.count("*"), F.count_distinct("emit_seq"), F.max("n")).first()
    assert got[0] == got[1] > 200_300 and got[2] <= 203
    lines = rows.where("discovery_method = 'REGEX'").groupBy("start_line").count().collect()
    assert {r.start_line: r["count"] for r in lines}[2] == 200_000


def test_packages_are_found_with_default_settings(spark, tmp_path):
    folder = tmp_path / "fs" / "usr" / "lib" / "node_modules" / "jose"
    folder.mkdir(parents=True)
    (folder / "package.json").write_text('{"name": "jose", "version": "5.1"}')
    rows = container.scan_container(container.filesystem(spark, str(tmp_path / "fs"))).collect()
    assert rows and {r.raw_symbol for r in rows} == {"jose@5.1"}


def test_unreadable_text_makes_a_scan_partial(spark, tree):
    found = files.with_language(files.with_text(files.scan_files(spark, tree)))
    out = inventory.run(found.select("path", "language", "text", "content"))
    assert [tuple(r) for r in out["errors"].collect()] == [("app/bad.py", "invalid UTF-8")]
    assert out["status"].first().status == "PARTIAL"
    assert inventory.scan_status(files.read_problems(found.where("path <> 'app/bad.py'"))).first().status == "COMPLETED"


HOSTILE = {"java": "\n", "cpp": "  \n", "javascript": "const { a\n", "c": "#include <\n", "typescript": "import { b\n"}


def test_import_scans_take_linear_time(spark):
    import time

    took = []
    for n in (50_000, 100_000):
        df = spark.createDataFrame([(k, k, unit * n + "import java.security.Key;\n") for k, unit in HOSTILE.items()], "path string, language string, text string")
        start = time.time()
        assert repository.matched_imports(df).count() >= 1
        took.append(time.time() - start)
    assert took[1] < 2.5 * took[0] + 2


def test_imports_behind_blank_lines(spark):
    java = "package x;\n\n \t\n\nimport java.security.Key;\nimport javax.crypto.Cipher;\n\nimport  javax.crypto.Mac ;\n"
    js = "const {\n  a,\n  b\n} = require('crypto')\nimport { c } from 'crypto'\nconst { d: { e } } = f\n"
    df = spark.createDataFrame([("A.java", "java", java), ("b.js", "javascript", js)], "path string, language string, text string")
    got = sorted((r["path"], r["line"], r["module"]) for r in repository.matched_imports(df).collect())
    # As ever, a statement's line is that of the first blank line before it.
    assert got == [("A.java", 2, "java.security.Key"), ("A.java", 6, "javax.crypto.Cipher"), ("A.java", 7, "javax.crypto.Mac"), ("b.js", 1, "crypto"), ("b.js", 5, "crypto")]


def test_imports_read_the_texts_once(spark):
    files = spark.createDataFrame([("a.py", "python", "import hmac as h\nfrom hashlib import md5"), ("a.java", "java", "import javax.crypto.Cipher;")], "path string, language string, text string")
    found = repository.scan_imports(files)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[0] for r in found.select("raw_symbol").collect()) == ["from hashlib import md5", "import hmac as h", "import javax.crypto.Cipher;"]


def test_tables_of_one_file_are_dealt_by_size(spark, tmp_path, monkeypatch):
    from checks import derived

    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(derived, "_PART_BYTES", 1000)
    found = derived.table(spark, str(tmp_path), "orders")
    assert found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert found.distinct().count() == 20_000


def test_patterns_are_tried_where_they_may_match(spark):
    """What a pattern's matches hold is looked for first, and loses none of them, in any case and
    with letters that only count as such in another case."""
    import random
    import re

    from keystrata.dims import patterns

    one = [r for r in patterns.pattern_rows() if r["pattern"] not in patterns.MULTILINE]
    assert set(patterns.HOLDS) == {r["pattern"] for r in one}
    names = ["rsa", "rsa-2048", "aes", "aes-256-gcm", "AES_128", "aes192", "sha256", "sha-512", "SHA_1", "sha384", "sha3", "sha-3-256", "md5", "MD-5", "3des", "des-ede3", "tripledes",
             "tdea", "des", "ecdsa", "ec-dsa", "elliptic curve", "secp256r1", "secp521r1", "prime256v1", "ecdhe", "x25519", "x448", "ed25519", "edwards25519", "eddsa", "pkcs1", "pkcs1-oaep",
             "oaep", "pss", "rsaes", "rsassa", "aes.mode_gcm", "hmac-sha256", "hmac", "rc4", "arcfour", "arc4", "tls_rsa_with_aes_128", "sslv3", "ssl2", "tlsv1", "tls_v1_0", "tlsv1.0",
             "tlsv1_client_method", "pbkdf2-hmac", "pbkdf2hma", "bcrypt", "argon2id", "scrypt", "ml-kem", "mlkem", "crystals-kyber", "kyber", "ml_dsa", "dilithium", "crystals_dilithium",
             "slh-dsa", "slhdsa", "sphincs+", "none"]
    r = random.Random(4)
    case = lambda s: "".join(r.choice([c.upper(), c]) for c in s)
    texts = [" ".join(case(n) for n in r.sample(names, 3)) for _ in range(600)] + ["R\u017fA \u017fha256", "\u212ayber", "ell\u0131pt\u0131c curve"]
    files = spark.createDataFrame([(str(i), "python", t) for i, t in enumerate(texts)], "path string, analyzer string, text string")
    got = sorted((x["path"], x["pattern"], x["symbol"]) for x in repository.pattern_hits(files).collect())
    want = sorted((str(i), p["pattern"], m[0]) for i, t in enumerate(texts[:600]) for p in one for m in re.finditer(p["regex"], t, re.I))
    assert [x for x in got if int(x[0]) < 600] == want and len(want) > 1500
    assert {x[1] for x in got if int(x[0]) >= 600} == {"RSA_generic", "SHA256_variants", "ML_KEM_identifier", "ECDSA_variants"}
    assert {x[1] for x in want} == set(patterns.HOLDS)
