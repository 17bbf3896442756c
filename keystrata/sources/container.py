"""Findings from an extracted container filesystem: shared libraries, TLS files, packages.

Input is a table of files with paths relative to the filesystem root (path, name, and text
where contents are read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.dims import patterns
from keystrata.functions.binding import bind
from keystrata.functions.text import lookup, pattern, text_hits
from keystrata.operators.lookups import match_library, match_shared_lib
from keystrata.schemas import CONTAINER_CONTEXT
from keystrata.sources.files import scan_files, with_text
from keystrata.sources.repository import emission, finding, union_all

# --- fixed values -----------------------------------------------------------
LIBRARY_DIRS = [
    "usr/lib", "usr/lib/x86_64-linux-gnu", "usr/lib/aarch64-linux-gnu", "usr/local/lib", "lib",
    "lib/x86_64-linux-gnu", "lib64", "usr/lib64",
]
CRYPTO_FRAGMENTS = [
    "ssl", "crypto", "tls", "openssl", "mbedtls", "sodium", "gcrypt", "nss", "boringssl", "gnutls", "nettle",
    "wolfssl", "polarssl",
]
TLS_DIRS = ["etc/ssl", "etc/openssl", "etc/tls", "etc/pki"]
CONFIG_EXTENSIONS = ["conf", "cnf", "cfg", "ini", "yaml", "yml", "json", "pem", "crt", "cer", "key"]
DPKG_STATUS = "var/lib/dpkg/status"
SITE_PACKAGES = [
    "usr/lib/python3/dist-packages", "usr/local/lib/python3.10/dist-packages",
    "usr/local/lib/python3.11/site-packages", "usr/local/lib/python3.12/site-packages",
    "usr/lib/python3.10/site-packages", "usr/lib/python3.11/site-packages",
]
NODE_MODULES = ["usr/lib/node_modules", "usr/local/lib/node_modules"]
# --- end of fixed values ----------------------------------------------------

_FILES, _PACKAGES = "ContainerScanner/FilesystemInspector", "ContainerScanner/PackageInspector"
_LIBS, _DPKG, _PIP, _NPM, _PEM, _KEYS = 1, 2, 3, 4, 5, 6


def filesystem(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """Files of an extracted filesystem with their text. Nothing is left out unless asked for:
    the exclusions for source trees would hide node_modules, where ``scan_npm`` looks."""
    return with_text(scan_files(spark, root, exclude or []))


def container_context(image: str | None = None, layer: str | None = None, root: str = "/") -> Column:
    return F.struct(
        F.lit(image).alias("image_reference"), F.lit(layer).alias("layer_id"), F.lit(root).alias("filesystem_path")
    ).cast(CONTAINER_CONTEXT)


def _folder() -> Column:
    return F.regexp_extract("path", "^(.*)/[^/]*$", 1)


def _algorithms(most: int | None) -> Column:
    """A library's leading algorithms, all unless limited; one null where there are none."""
    listed = F.col("primary_algorithms") if most is None else F.slice("primary_algorithms", 1, most)
    return F.posexplode_outer(listed).alias("place", "algorithm")


def scan_shared_libs(files: DataFrame, context: Column, most: int | None = None) -> DataFrame:
    """Crypto-named shared objects in the standard directories: one finding per algorithm of
    a known library (the first ``most`` if given), one general finding for an unknown one."""
    low = F.lower("name")
    named = F.lit(False)
    for part in CRYPTO_FRAGMENTS:
        named = named | F.contains(low, F.lit(part))
    shared = F.contains(low, F.lit(".so")) | F.endswith(low, F.lit(".dylib"))
    objects = files.where(_folder().isin(LIBRARY_DIRS) & shared & named).select("path", "name")
    rows = match_shared_lib(objects, "name").select("*", _algorithms(most))
    known = F.col("library").isNotNull()
    rows = bind(
        rows,
        _score=F.when(known, F.round(F.least(F.col("base_confidence") + 0.10, F.lit(0.95)), 4)).otherwise(0.55),
        snippet=F.concat(F.when(known, "Shared library: ").otherwise("Unlisted shared library: "), F.col("name")),
    )
    return finding(
        rows, "LIBRARY_DETECTION", "LIBRARY", _FILES, emission(_LIBS, 0, F.coalesce("place", F.lit(0))),
        F.col("_score"), F.format_string("shared object %s | score=%.2f", "name", "_score"), F.col("name"),
        suspected_algorithm=F.col("algorithm"), library_hint=F.col("library"), container_context=context,
    )


def scan_tls_config(files: DataFrame, context: Column) -> DataFrame:
    """PEM blocks and key material in the TLS directories."""
    inside = F.lit(False)
    for d in TLS_DIRS:
        inside = inside | F.startswith(F.col("path"), F.lit(d + "/"))
    extension = F.lower(F.regexp_extract("name", r"[^.]\.([^.]+)$", 1))
    texts = files.where(
        inside & extension.isin(CONFIG_EXTENSIONS) & F.contains(F.col("text"), F.lit("-----"))
    ).select("path", "text")
    rows = {str(r["pattern_ordinal"]): r for r in patterns.pattern_rows() if r["category"] in ("KEY_MATERIAL", "CERTIFICATE")}
    hits = text_hits(texts, {"pem": pattern(patterns.CONFIG_PEM_BLOCK, False), **{k: pattern(r["regex"]) for k, r in rows.items()}})
    pem = F.col("which") == "pem"
    of = lambda field: lookup(F.col("which"), {k: r[field] for k, r in rows.items()})
    hits = bind(
        hits, score=F.when(pem, 0.95).otherwise(of("base_confidence")), pattern=of("pattern"), category=F.when(pem, "CERTIFICATE").otherwise(of("category")),
        suspect=lookup(F.col("which"), {k: r["algorithm"] for k, r in rows.items() if r["algorithm"]}) if any(r["algorithm"] for r in rows.values()) else F.lit(None).cast("string"),
        snippet=F.when(pem, F.col("symbol")).otherwise(F.col("snippet")))
    return finding(
        hits, F.when(pem, "STRING_ANALYSIS").otherwise("REGEX"), F.col("category"), _FILES,
        F.when(pem, emission(_PEM, 0, F.col("place"))).otherwise(emission(_KEYS, F.when(pem, 0).otherwise(F.col("which").try_cast("int")), F.col("place"))),
        F.col("score"), F.when(pem, "PEM block | score=0.95").otherwise(F.format_string("pattern %s | score=%.2f", "pattern", "score")),
        F.col("symbol"), suspected_algorithm=F.col("suspect"), container_context=context,
    )


def _package_findings(packages: DataFrame, manager: str, sep: str, phase: int, context: Column, most: int | None = None) -> DataFrame:
    """Findings for (path, snippet, package, version, seq) rows of known packages: one per
    algorithm of the library, or of the first ``most``."""
    known = match_library(packages, "package", "package").where(F.col("library").isNotNull()).select("*", _algorithms(most))
    known = bind(known, _score=F.round(F.least(F.col("base_confidence") + 0.05, F.lit(0.90)), 4))
    return finding(
        known, "PACKAGE_INSPECTION", "LIBRARY", _PACKAGES, emission(phase, F.coalesce("place", F.lit(0)), F.col("seq")), F.col("_score"),
        F.format_string(manager + " package %s %s | score=%.2f", "package", "version", "_score"),
        F.concat("package", F.lit(sep), "version"),
        suspected_algorithm=F.col("algorithm"), library_hint=F.col("library"),
        raw_parameters=F.create_map(
            F.lit("package"), F.col("package"), F.lit("version"), F.col("version"), F.lit("manager"), F.lit(manager)
        ),
        container_context=context,
    )


def scan_dpkg(files: DataFrame, context: Column, most: int | None = None) -> DataFrame:
    """Known packages of the package status file; it is read once."""
    stanzas = files.where(F.col("path") == DPKG_STATUS).select("path", F.posexplode(F.split("text", "\n\n", -1)).alias("seq", "stanza"))
    field = lambda name: F.trim(F.regexp_extract("stanza", rf"(?md)^{name}:\s*(.+)$", 1))
    rows = stanzas.select("path", "seq", field("Package").alias("package"), field("Version").alias("version"))
    rows = rows.where(F.col("package") != "").withColumn(
        "version", F.when(F.col("version") != "", F.col("version")).otherwise("unknown")
    )
    rows = rows.withColumn("snippet", F.concat(F.lit("Package: "), "package", F.lit("\nVersion: "), "version"))
    return _package_findings(rows, "dpkg", "==", _DPKG, context, most)


def scan_pip(files: DataFrame, context: Column, most: int | None = None) -> DataFrame:
    """Known packages of Python site directories; the version is read from METADATA, else
    PKG-INFO, of the package's directory."""
    sites = "|".join(s.replace(".", r"\.") for s in SITE_PACKAGES)
    folder = rf"^((?:{sites})/([^/]+))/"
    inside = files.where(F.col("path").rlike(folder)).select(
        F.regexp_extract("path", folder, 1).alias("folder"),
        F.lower(F.substring_index(F.regexp_extract("path", folder, 2), "-", 1)).alias("package"),
        F.when(F.col("path").rlike(folder + "METADATA$"), 1).when(F.col("path").rlike(folder + "PKG-INFO$"), 2).alias("rank"),
        F.trim(F.regexp_extract("text", r"(?md)^Version:(.*)$", 1)).alias("found"),
    )
    rows = inside.groupBy("folder", "package").agg(
        F.min(F.when(F.col("rank").isNotNull() & (F.col("found") != ""), F.struct("rank", "found")))["found"].alias("version")
    )
    rows = rows.select(
        F.col("folder").alias("path"), F.lit(0).alias("seq"), "package", F.coalesce("version", F.lit("unknown")).alias("version")
    ).withColumn("snippet", F.concat(F.lit("Python package: "), "package", F.lit(" "), "version"))
    return _package_findings(rows, "pip", "==", _PIP, context, most)


def scan_npm(files: DataFrame, context: Column, most: int | None = None) -> DataFrame:
    """Known packages directly below node_modules; unknown version where package.json is
    missing or no JSON."""
    roots = "|".join(NODE_MODULES)
    folder = rf"^((?:{roots})/([^/]+))/"
    inside = files.where(F.col("path").rlike(folder)).select(
        F.regexp_extract("path", folder, 1).alias("folder"),
        F.lower(F.regexp_extract("path", folder, 2)).alias("package"),
        F.when(F.col("path").rlike(folder + r"package\.json$"), F.get_json_object("text", "$.version")).alias("found"),
    )
    rows = inside.groupBy("folder", "package").agg(F.max("found").alias("version"))
    rows = rows.select(
        F.concat("folder", F.lit("/package.json")).alias("path"), F.lit(0).alias("seq"), "package",
        F.coalesce("version", F.lit("unknown")).alias("version"),
    ).withColumn("snippet", F.concat(F.lit("npm package: "), "package", F.lit("@"), "version"))
    return _package_findings(rows, "npm", "@", _NPM, context, most)


def scan_container(files: DataFrame, context: Column | None = None) -> DataFrame:
    """All findings of an extracted filesystem (path, name, text)."""
    context = container_context() if context is None else context
    return union_all([
        scan_shared_libs(files, context), scan_dpkg(files, context), scan_pip(files, context), scan_npm(files, context),
        scan_tls_config(files, context),
    ])
