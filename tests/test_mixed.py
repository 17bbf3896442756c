"""One scan over source, binaries and a container filesystem."""

import pytest
from pyspark.sql import functions as F

from keystrata.plans import inventory
from keystrata.sources import binary, files, mixed, repository

ELF = b"\x7fELF" + bytes(12)
TREE = {
    "app/main.py": b"import hashlib\nh = hashlib.md5(x)\n", "app/bad.py": b"h = 'AES \xff'\n", "app/notes.txt": b"RSA",
    "app/node_modules/x/index.js": b"crypto.createHash('md5')", "app/tool": ELF + b"OpenSSL 1.1.1k\x00RSA_sign\x00AES-256-GCM\x00",
    "usr/lib/libssl.so.3": ELF + b"OpenSSL 3.0.2 15 Mar\x00TLS_RSA_WITH_NULL_MD5\x00", "var/lib/dpkg/status": b"Package: openssl\nVersion: 3\n\nPackage: bash\nVersion: 5\n",
    "usr/lib/python3/dist-packages/bcrypt-4.0.dist-info/METADATA": b"Name: bcrypt\nVersion: 4.0\n", "usr/lib/node_modules/jose/package.json": b'{"version": "5.1"}',
    "etc/ssl/c.pem": b"-----BEGIN CERTIFICATE-----\n", "usr/lib/python3/dist-packages/paramiko/client.py": b"import hashlib\n", "win.exe": b"MZ" + bytes(20) + b"BCryptEncrypt AES\x00",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("mixed")
    for start in ("", "img/one/"):
        for name, content in TREE.items():
            path = root / ("all" if not start else "nested") / (start + name)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
    return str(root / "all"), str(root / "nested")


def test_routes(spark, tree):
    found = files.scan_files(spark, tree[0], mixed.EXCLUDES)
    got = {r["path"]: set(r["targets"]) for r in mixed.routed(found).collect()}
    assert {k: v for k, v in got.items() if v} == {
        "app/main.py": {"repository"}, "app/bad.py": {"repository"}, "app/tool": {"binary"}, "win.exe": {"binary"}, "usr/lib/libssl.so.3": {"binary", "container"},
        "var/lib/dpkg/status": {"container"}, "usr/lib/python3/dist-packages/bcrypt-4.0.dist-info/METADATA": {"container"}, "usr/lib/node_modules/jose/package.json": {"container"},
        "etc/ssl/c.pem": {"container"}, "usr/lib/python3/dist-packages/paramiko/client.py": {"repository", "container"}}
    assert set(got) == set(TREE)


def by_scanner(findings):
    return {r["k"]: r["n"] for r in findings.groupBy(F.concat_ws(":", "scanner_name", "discovery_method").alias("k")).count().withColumnRenamed("count", "n").collect()}


def test_run_without_a_kind(spark, tree):
    out = inventory.run(files.scan_files(spark, tree[0], mixed.EXCLUDES), x=10.0)
    symbols = {r["raw_symbol"] for r in out["findings"].collect()}
    assert {"import hashlib", "hashlib.md5", "openssl==3", "bcrypt==4.0", "jose@5.1", "libssl.so.3", "TLS_RSA_WITH_NULL_MD5", "OpenSSL 1.1.1k", "-----BEGIN CERTIFICATE-----"} <= symbols
    assert out["status"].first().status == "PARTIAL" and [tuple(r) for r in out["errors"].collect()] == [("app/bad.py", "invalid UTF-8")]
    row = out["counters"].first()
    assert (row.files_discovered, row.files_scanned, row.files_errored, row.source_files, row.binary_files, row.container_files) == (12, 10, 1, 3, 3, 6)
    assert row.bytes_discovered == sum(map(len, TREE.values()))
    assert out["assets"].count() > 5 and out["risk"].count() == out["assets"].count()
    # Each part as its scanner finds it alone.
    alone = files.with_binary_format(files.with_language(files.scan_files(spark, tree[0], mixed.EXCLUDES)))
    strings = binary.scan_binary_strings(files.printable_strings(alone.where("binary_format in ('ELF', 'PE')")))
    assert by_scanner(strings).items() <= by_scanner(out["findings"]).items()
    source = repository.scan_repository(files.with_text(alone).where("language = 'python'").select("path", "language", "text"))
    assert by_scanner(source).items() <= by_scanner(out["findings"]).items()


def test_filesystem_root_below_the_tree(spark, tree):
    outer = mixed.scan_tree(spark, tree[1])
    inner = mixed.scan_tree(spark, tree[1], roots=("img/one",))
    assert not outer.findings.where("container_context is not null").count()
    found = inner.findings.where("container_context is not null")
    assert {r["p"] for r in found.select(F.col("location.file_path").alias("p")).distinct().collect()} >= {"img/one/usr/lib/libssl.so.3", "img/one/var/lib/dpkg/status"}
    assert {r["r"] for r in found.select(F.col("container_context.filesystem_path").alias("r")).distinct().collect()} == {"/img/one"}


def test_symbols_join_in(spark, tree):
    symbols = spark.createDataFrame([("app/tool", "RSA_sign", None, "ELF"), ("app/tool", "EVP_sha512", None, "ELF")], "path string, symbol string, dll string, binary_format string")
    found = mixed.scan_tree(spark, tree[0], symbols=symbols).findings
    assert {r["raw_symbol"] for r in found.where("discovery_method = 'SYMBOL_INSPECTION'").collect()} >= {"RSA_sign", "EVP_sha512"}


def test_large_files_go_by_ranges(spark, tree):
    small, by_range = mixed.scan_tree(spark, tree[0]), mixed.scan_tree(spark, tree[0], large=30)
    kinds = "container_context is null or discovery_method = 'LIBRARY_DETECTION'"
    key = ["location.file_path", "location.byte_offset", "location.start_line", "raw_symbol", "discovery_method", "confidence_score"]
    assert sorted(map(str, by_range.findings.where(kinds).select(key).collect())) == sorted(map(str, small.findings.where(kinds).select(key).collect()))
    a, b = small.counters.first(), by_range.counters.first()
    assert a.files_discovered == b.files_discovered and (a.source_files, a.binary_files, a.large_files) == (b.source_files, b.binary_files, 0) and b.large_files == 5 and a.bytes_discovered == b.bytes_discovered


def test_lists_too_large_for_a_row_are_errors(spark, tree):
    scan = mixed.scan_tree(spark, tree[0], large=30)
    assert {tuple(r) for r in scan.errors.collect()} == {("app/bad.py", "invalid UTF-8"), ("var/lib/dpkg/status", "too large for a list or configuration")} - (
        {("app/bad.py", "invalid UTF-8")} if len(TREE["app/bad.py"]) > 30 else set())


def test_nothing_to_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x")
    scan = mixed.scan_tree(spark, str(tmp_path))
    assert scan.findings.count() == scan.errors.count() == 0 and scan.counters.first().files_unclaimed == 1
