"""Checks of whole results: everything scanners find by default, ranks of all rows, details
with their evidence, routes of mixed trees."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import asset_sql as A
from checks import assets, findings, sources
from checks.derived import asset_facts, for_duckdb, for_spark, timeline_inputs, with_location
from keystrata.operators import listing, merge, textindex, timeline
from keystrata.operators.classify import classify
from keystrata.session import checkpoint_folder
from keystrata.sources import binary, container, mixed

QUERIES, SQL = {}, {}


def check(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return register


# --- scanners with all algorithms of a library ------------------------------

_OPENSSL, _SODIUM = sources._all_algorithms("OpenSSL"), sources._all_algorithms("libsodium")


def _context():
    return container.container_context("image:1")


@check("shared_libs_whole", sources._tree_expected(
    [("usr/lib/libssl.so.3", "usr/lib/libssl.so.3", "libssl.so.3", a, "OpenSSL", 0.95) for a in _OPENSSL]
    + [("lib64/libgnutls.so.30", "lib64/libgnutls.so.30", "libgnutls.so.30", None, None, 0.55)]))
def _(spark, sf):
    return sources._counted(container.scan_shared_libs(sources.tree(spark, sf), _context()))


@check("dpkg_whole", sources._tree_expected(
    [(sources._D, sources._D, "openssl==3.0", a, "OpenSSL", 0.90) for a in _OPENSSL] + [(sources._D, sources._D, "libsodium==unknown", a, "libsodium", 0.90) for a in _SODIUM]))
def _(spark, sf):
    return sources._counted(container.scan_dpkg(sources.tree(spark, sf), _context()))


@check("pip_whole", sources._tree_expected([(sources._B + "/METADATA", sources._B, "bcrypt==4.0", a, "bcryptjs", 0.83) for a in sources._all_algorithms("bcryptjs")], True))
def _(spark, sf):
    return sources._counted(container.scan_pip(sources.tree(spark, sf), _context()))


@check("npm_whole", sources._tree_expected(
    [(sources._N + "jose/package.json", sources._N + "jose/package.json", "jose@5.1", a, "jose", 0.75) for a in sources._all_algorithms("jose")]
    + [(sources._N + "jsonwebtoken/package.json", sources._N + "jsonwebtoken/package.json", "jsonwebtoken@unknown", a, "jsonwebtoken", 0.77) for a in sources._all_algorithms("jsonwebtoken")], True))
def _(spark, sf):
    return sources._counted(container.scan_npm(sources.tree(spark, sf), _context()))


@check("library_summary_whole", sources.SQL["library_summary"].replace("FROM s JOIN want USING (i) WHERE i >= 3)", "FROM s JOIN want USING (i))"))
def _(spark, sf):
    symbols = binary.scan_symbols(for_spark(spark, sf, sources.SYMBOLS))
    correlated = binary.correlate(binary.scan_binary_strings(for_spark(spark, sf, sources.STRINGS)), symbols)
    return binary.library_summary(symbols, correlated).select(F.col("location.file_path").alias("path"), "library_hint", "raw_symbol")


# --- all rows in order, details, explanations -------------------------------


@check("canonical_ranks", A.with_ctes(A.FACTS, select="SELECT asset_id, row_number() OVER (ORDER BY file_path, coalesce(start_line, 0), algorithm, asset_id) AS rank FROM facts"))
def _(spark, sf):
    rows = with_location(asset_facts(spark, sf))
    return listing.ranked(rows, F.col("location.file_path"), F.coalesce(F.col("location.start_line"), F.lit(0)), F.col("algorithm"), F.col("asset_id")).select("asset_id", "rank")


@check("page_at", A.with_ctes(A.FACTS, select="SELECT asset_id, row_number() OVER (ORDER BY confidence_score DESC, asset_id) AS rank FROM facts QUALIFY rank BETWEEN 201 AND 250"))
def _(spark, sf):
    return listing.page_at(listing.ranked(asset_facts(spark, sf), F.col("confidence_score").desc(), F.col("asset_id")), 5, 50).select("asset_id", "rank")


@check("asset_detail", f"""WITH RECURSIVE {findings.NORM}, {findings.FIT}, {findings.ASSETS}
SELECT a.asset_id, a.algorithm, count(*) AS n, string_agg(p.finding_id, ',' ORDER BY p.emit_seq, p.finding_id) AS ids, string_agg(CAST(p.start_line AS VARCHAR), ',' ORDER BY p.emit_seq, p.finding_id) AS lines,
  string_agg(p.discovery_method, ',' ORDER BY p.emit_seq, p.finding_id) AS methods FROM placed p JOIN asset a USING (file_path, leader_id) GROUP BY a.asset_id, a.algorithm, a.leader_id""")
def _(spark, sf):
    found, evidence = merge.build_assets(findings.normalized(spark, sf))
    joined = lambda c: F.array_join(F.transform("supporting_findings", lambda x: x[c].cast("string")), ",")
    return listing.asset_detail(found, evidence, 100_000).select(
        "asset_id", "algorithm", F.size("locations").cast("long").alias("n"), F.array_join("supporting_finding_ids", ",").alias("ids"),
        F.array_join(F.transform("locations", lambda x: x["start_line"].cast("string")), ",").alias("lines"), joined("discovery_method").alias("methods"))


@check("classification_notes", A.with_ctes(*assets._C, select="SELECT asset_id, classical_security_status AS classical, quantum_security_status AS quantum FROM classified"))
def _(spark, sf):
    part = lambda name, of: F.regexp_extract("classification_notes", rf"{name} \[([^\]]*)\]", 1).alias(of)
    return classify(asset_facts(spark, sf)).select("asset_id", part("Classical", "classical"), part("Quantum", "quantum"))


@check("timeline_rationale", A.with_ctes(*assets._C, A.TIMED, select="""SELECT asset_id, CASE WHEN applicable THEN 3 ELSE 1 END AS lines,
  CASE WHEN applicable THEN 'urgency ' || urgency ELSE 'no migration is required' END AS last FROM timed"""))
def _(spark, sf):
    facts = asset_facts(spark, sf)
    timed = timeline.assess_timeline(classify(facts, notes=False), timeline_inputs(facts), explain=True)
    return timed.select("asset_id", F.size("rationale").alias("lines"), F.element_at("rationale", -1).alias("last"))


def _indexed(spark: SparkSession, sf: str, *needles: str) -> DataFrame:
    facts, fields, folder = asset_facts(spark, sf), ["algorithm", "implementation_library"], f"{checkpoint_folder(spark)}/index-{uuid.uuid4()}"
    textindex.build(facts, folder, "asset_id", fields, "file_path")
    found = [textindex.find(spark, folder, n, "asset_id", fields, "file_path").select("asset_id") for n in needles]
    return reduce(DataFrame.unionByName, found).distinct()


@check("indexed_search", assets.SQL["search_assets"])
def _(spark, sf):
    return _indexed(spark, sf, " RSA OpenSSL ", "SRC3/mod7.")


# --- mixed trees ------------------------------------------------------------

# Every document as a file of one of seven kinds.
_FILES = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('src/m', doc_id, '.py') WHEN 1 THEN concat('bin/b', doc_id) WHEN 2 THEN concat('etc/ssl/c', doc_id, '.conf')
  WHEN 3 THEN concat('usr/lib/libssl.so.', doc_id) WHEN 4 THEN concat('usr/lib/node_modules/p', doc_id, '/package.json') WHEN 5 THEN concat('notes/n', doc_id, '.txt') ELSE concat('web/w', doc_id, '.js') END AS path,
  doc_id % 7 IN (1, 3) AS elf, text FROM {documents} WHERE text IS NOT NULL
"""
_ROUTES = f"""files AS ({for_duckdb(_FILES)}),
route AS (SELECT path, 4 * CAST(elf AS INT) + strlen(text) AS length,
  CASE WHEN elf THEN 'binary' WHEN doc_id % 7 = 0 THEN 'python' WHEN doc_id % 7 = 4 THEN 'manifest' WHEN doc_id % 7 = 6 THEN 'javascript' ELSE 'unknown' END AS language,
  CASE WHEN elf THEN 'ELF' ELSE 'UNKNOWN' END AS binary_format,
  CASE doc_id % 7 WHEN 0 THEN 'repository' WHEN 1 THEN 'binary' WHEN 2 THEN 'container' WHEN 3 THEN 'binary,container' WHEN 4 THEN 'container' WHEN 5 THEN '' ELSE 'repository' END AS targets FROM files)"""


def mixed_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = for_spark(spark, sf, _FILES)
    content = F.concat(F.when(F.col("elf"), F.unhex(F.lit("7F454C46"))).otherwise(F.unhex(F.lit(""))), F.col("text").cast("binary"))
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


@check("mixed_routes", f"WITH {_ROUTES} SELECT path, CAST(length AS BIGINT) AS length, language, binary_format, targets FROM route")
def _(spark, sf):
    return mixed.routed(mixed_files(spark, sf)).select("path", "length", "language", "binary_format", F.array_join("targets", ",").alias("targets"))


@check("mixed_counters", f"""WITH {_ROUTES} SELECT count(*) AS files_discovered, CAST(sum(length) AS BIGINT) AS bytes_discovered, count(*) FILTER (WHERE targets <> '') AS files_scanned,
  count(*) FILTER (WHERE targets = '') AS files_unclaimed, 0 AS files_errored, count(*) FILTER (WHERE targets LIKE '%repository%') AS source_files,
  count(*) FILTER (WHERE targets LIKE '%binary%') AS binary_files, count(*) FILTER (WHERE targets LIKE '%container%') AS container_files, 0 AS large_files FROM route""")
def _(spark, sf):
    return mixed.scan_files_mixed(mixed_files(spark, sf)).counters


@check("mixed_libraries", f"""WITH {_ROUTES}, algorithm AS (SELECT unnest({_OPENSSL}) AS suspected_algorithm)
SELECT path, suspected_algorithm, 'OpenSSL' AS library_hint FROM route, algorithm WHERE targets = 'binary,container'""")
def _(spark, sf):
    found = mixed.scan_files_mixed(mixed_files(spark, sf)).findings.where("discovery_method = 'LIBRARY_DETECTION'")
    return found.select(F.col("location.file_path").alias("path"), "suspected_algorithm", "library_hint")
