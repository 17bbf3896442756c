"""Checks of the scanners: text patterns over documents, source files, containers, binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import for_duckdb, for_spark, table
from checks.findings import _SYM, _PRE, values
from keystrata.dims import libraries, patterns
from keystrata.functions.text import text_lines
from keystrata.session import checkpointed
from keystrata.sources import binary, container, files, repository

QUERIES, SQL = {}, {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# --- patterns over whole documents ------------------------------------------

# DuckDB's word boundary knows ASCII only, so letters beyond it are mapped to a plain letter
# no pattern contains and any other character beyond it to a space.
_ASCII = "regexp_replace(regexp_replace({}, '[\\x{{C0}}-\\x{{24F}}]', 'q', 'g'), '[\\x{{80}}-\\x{{10FFFF}}]', ' ', 'g')"

def _each_pattern(columns: str, source: str) -> str:
    """One branch per pattern, so that every regex is a constant to DuckDB."""
    def quoted(r: dict) -> str:
        return "'(?i)" + r["regex"].replace("'", "''") + "'"

    return " UNION ALL ".join(
        f"SELECT {columns}, {r['pattern_ordinal']} AS ordinal, unnest(regexp_extract_all(l, {quoted(r)})) AS symbol FROM {source} "
        f"WHERE regexp_matches(l, {quoted(r)})" for r in patterns.pattern_rows())


_PATTERNS = f"pat(ordinal, pattern, algorithm, base, remark) AS {values([(r['pattern_ordinal'], r['pattern'], r['algorithm'], r['base_confidence'], r['comment_confidence']) for r in patterns.pattern_rows()])}"


def _pattern_sql(source: str, key: str, text: str) -> str:
    return f"""
WITH {_PATTERNS},
line AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS l, generate_subscripts(string_split({text}, chr(10)), 1) AS line FROM {source}),
ascii AS (SELECT {key}, CAST(line AS INT) AS line, {_ASCII.format('l')} AS l FROM line),
hit AS ({_each_pattern(key + ', line', 'ascii')})
SELECT {key}, line, pattern, symbol FROM hit JOIN pat USING (ordinal)"""


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.lit("python").alias("analyzer"), "text")


@check("pattern_hits_documents", _pattern_sql("documents", "doc_id", "text"))
def _(spark, sf):
    return repository.pattern_hits(document_files(spark, sf)).select("doc_id", "line", "pattern", "symbol")


@check("pattern_hits_pages", _pattern_sql("pages", "page_id", "html"))
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.lit("javascript").alias("analyzer"), F.col("html").alias("text"))
    return repository.pattern_hits(pages).select("page_id", "line", "pattern", "symbol")


@check("pattern_hits_conversations", _pattern_sql("conversations", "conv_id, turn", "text"))
def _(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", F.lit("python").alias("analyzer"), "text")
    return repository.pattern_hits(talk).select("conv_id", "turn", "line", "pattern", "symbol")


@check("line_counts", """
SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*#'))) AS comments FROM documents""")
def _(spark, sf):
    from keystrata.functions.text import is_comment

    lines = text_lines(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(lines).cast("long").alias("lines"),
        F.size(F.filter(lines, lambda l: is_comment(l, "python"))).cast("long").alias("comments"))


# --- source files -----------------------------------------------------------

_PY = """import hashlib
from Crypto.Cipher import AES, DES
from cryptography.hazmat.primitives.asymmetric import rsa
import os, hmac as h

# RSA-2048 in a comment, MD5 too
key = rsa.generate_private_key(public_exponent=65537, key_size=3072)
c = AES.new(k, AES.MODE_GCM)
d = hashlib.sha256(data).hexdigest()
t = "TLSv1 and SHA-1 and secp384r1"
"""
_JS = """const crypto = require('crypto');
import { sign } from 'jsonwebtoken';
// crypto.createHash('md5')
const h = crypto.createHash('sha256');
jwt.sign(payload, key, { algorithm: 'RS256' });
"""
_JAVA = """import javax.crypto.Cipher;
import java.util.List;

import org.bouncycastle.jce.Provider;
class A { Cipher c = Cipher.getInstance("AES/CBC/PKCS5Padding"); }
// MessageDigest.getInstance("MD5")
Object m = MessageDigest . getInstance( "SHA-512" );
"""
_C = """#include <openssl/evp.h>
#include "mbedtls/aes.h"
#include <stdio.h>
RSA_generate_key_ex(rsa, 4096, e, NULL);
EVP_EncryptInit_ex(ctx, EVP_aes_256_gcm(), NULL, k, iv);
// SHA256(data)
SHA256 (data, n, out);
"""
_TEMPLATES = [("python", "py", _PY), ("javascript", "js", _JS), ("java", "java", _JAVA), ("c", "c", _C), ("go", "go", "AES and RSA\n")]


def _lines(text: str) -> str:
    """A text as an SQL expression without line ends in literals."""
    return "concat_ws(chr(10), " + ", ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


_CASE = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN {_lines(t)}" for i, (_, _, t) in enumerate(_TEMPLATES)) + " END"
_LANG = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{lang}'" for i, (lang, _, _) in enumerate(_TEMPLATES)) + " END"
# Each file starts with a number of marker lines, so that line numbers differ between files.
SOURCES = f"""
SELECT concat('repo/file', o_orderkey, '-', o_custkey) AS path, {_LANG} AS language, CAST(o_custkey % 4 AS INT) AS shift,
  concat(repeat(concat('x', chr(10)), CAST(o_custkey % 4 AS INT)), {_CASE}) AS text FROM {{orders}}
"""
_SOURCES = f"sources AS ({for_duckdb(SOURCES)})"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return for_spark(spark, sf, SOURCES)


def _expected(rows: list[tuple], columns: str) -> str:
    """Expected hits per language, shifted to each file's own line numbers."""
    names = [c.strip() for c in columns.split(",")]
    return f"""WITH {_SOURCES}, want(language, line, {columns}) AS {values(rows)}
SELECT path, CAST(want.line + shift AS INT) AS line, {', '.join('want.' + n for n in names)} FROM sources JOIN want USING (language)"""


def _flat(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("location.file_path").alias("path"), F.col("location.start_line").alias("line"), *more)


@check("scan_imports", _expected([
    ("python", 1, "import hashlib", "hashlib", 0.70), ("python", 2, "from Crypto.Cipher import AES, DES", "node:crypto", 0.70),
    ("python", 3, "from cryptography.hazmat.primitives.asymmetric import rsa", "cryptography", 0.70),
    ("python", 4, "import hmac as h", "hmac", 0.70),
    ("javascript", 1, "const crypto = require('crypto')", "node:crypto", 0.70),
    ("javascript", 2, "import { sign } from 'jsonwebtoken'", "jsonwebtoken", 0.70),
    ("java", 1, "import javax.crypto.Cipher;", "javax.crypto", 0.70), ("java", 3, "import org.bouncycastle.jce.Provider;", "BouncyCastle", 0.70),
    ("c", 1, "#include <openssl/evp.h>", "OpenSSL", 0.70), ("c", 2, '#include "mbedtls/aes.h"', "mbedTLS", 0.70),
], "raw_symbol, library_hint, confidence_score").replace("want.confidence_score", "CAST(want.confidence_score AS DOUBLE) AS confidence_score"))
def _(spark, sf):
    return _flat(repository.scan_imports(sources(spark, sf)), "raw_symbol", "library_hint", "confidence_score")


@check("scan_api_calls", _expected([
    ("python", 7, "rsa.generate_private_key", "RSA", 3072, None, 0.98), ("python", 8, "AES.new", "AES", None, "MODE_GCM", 0.98),
    ("python", 9, "hashlib.sha256", "SHA-256", None, None, 0.98),
    ("javascript", 4, "createHash(", "SHA-256", None, None, 0.72), ("javascript", 5, "sign(", "RSA", None, None, 0.72),
    ("c", 4, "RSA_generate_key_ex(", "RSA", 4096, None, 0.72), ("c", 5, "EVP_EncryptInit_ex(", "AES", None, None, 0.72),
    ("c", 7, "SHA256 (", "SHA-256", None, None, 0.72),
], "raw_symbol, suspected_algorithm, key_size_hint, mode_hint, confidence_score").replace("want.confidence_score", "CAST(want.confidence_score AS DOUBLE) AS confidence_score"))
def _(spark, sf):
    return _flat(repository.scan_api_calls(sources(spark, sf)), "raw_symbol", "suspected_algorithm", "key_size_hint", "mode_hint", "confidence_score")


@check("import_corroboration", f"""WITH {_SOURCES}, want(line, api_library, has_import) AS (VALUES (7, 'cryptography', TRUE), (8, 'pycryptodome', FALSE), (9, 'hashlib', TRUE))
SELECT path, CAST(want.line + shift AS INT) AS line, api_library, has_import FROM sources, want WHERE language = 'python'""")
def _(spark, sf):
    src = sources(spark, sf)
    calls = checkpointed(repository.python_calls(repository.analyzable(src)))
    imports = repository.matched_imports(src).select("path", F.lower("module").alias("module")).distinct()
    return repository.import_corroboration(calls, imports).select("path", "line", "api_library", "has_import")


@check("scan_java_factories", _expected([
    ("java", 5, 'Cipher.getInstance("AES/CBC/PKCS5Padding"', "AES", "SYMMETRIC_CIPHER", "AES/CBC/PKCS5Padding"),
    ("java", 7, 'MessageDigest . getInstance( "SHA-512"', "SHA-512", "HASH_FUNCTION", "SHA-512"),
], "raw_symbol, suspected_algorithm, artifact_category, transformation"))
def _(spark, sf):
    return _flat(repository.scan_java_factories(sources(spark, sf)), "raw_symbol", "suspected_algorithm", "artifact_category",
                 F.col("raw_parameters")["transformation"].alias("transformation"))


@check("scan_evp_ciphers", _expected([("c", 5, "EVP_aes_256_gcm()", "AES", "GCM")], "raw_symbol, suspected_algorithm, mode_hint"))
def _(spark, sf):
    return _flat(repository.scan_evp_ciphers(sources(spark, sf)), "raw_symbol", "suspected_algorithm", "mode_hint")


@check("scan_patterns", f"""
WITH {_SOURCES}, {_PATTERNS},
line AS (SELECT path, language, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM sources WHERE language <> 'go'),
hit AS ({_each_pattern('path, language, line, l', 'line')}),
scored AS (SELECT *, CASE WHEN language = 'python' THEN regexp_matches(l, '^\\s*#') ELSE regexp_matches(l, '^\\s*(//|\\*|/\\*)') END AS remarked FROM hit JOIN pat USING (ordinal))
SELECT path, CAST(line AS INT) AS line, symbol AS raw_symbol, algorithm AS suspected_algorithm, CAST(CASE WHEN remarked THEN remark ELSE base END AS DOUBLE) AS confidence_score
FROM scored WHERE NOT remarked OR remark >= CASE WHEN language = 'python' THEN 0.20 ELSE 0.22 END""")
def _(spark, sf):
    return _flat(repository.scan_patterns(sources(spark, sf)), "raw_symbol", "suspected_algorithm", "confidence_score")


@check("snippets", f"""
WITH {_SOURCES}, line AS (SELECT path, string_split(text, chr(10)) AS ls FROM sources WHERE language = 'c'),
at AS (SELECT path, ls, list_position(list_transform(ls, lambda l: contains(l, 'EVP_aes_256_gcm()')), TRUE) AS n FROM line)
SELECT path, CASE WHEN len(s) <= 200 THEN s ELSE left(s, 200) || '...' END AS snippet FROM (
  SELECT path, array_to_string(ls[greatest(1, n - 2):n + 2], chr(10)) AS s FROM at) q""".replace("\nat AS", "\nspot AS").replace("FROM at)", "FROM spot)"))
def _(spark, sf):
    return repository.scan_evp_ciphers(sources(spark, sf)).select(
        F.col("location.file_path").alias("path"), F.col("location.snippet").alias("snippet"))


@check("scan_repository", f"""
WITH {_SOURCES}, per(language, method, n) AS (VALUES ('python', 'IMPORT_ANALYSIS', 4), ('python', 'AST', 3), ('javascript', 'IMPORT_ANALYSIS', 2),
  ('javascript', 'API_CALL', 2), ('java', 'IMPORT_ANALYSIS', 2), ('java', 'API_CALL', 2), ('c', 'IMPORT_ANALYSIS', 2), ('c', 'API_CALL', 4)),
line AS (SELECT path, language, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM sources WHERE language <> 'go'),
{_PATTERNS}, hit AS ({_each_pattern('path, language, line, l', 'line')}),
scored AS (SELECT *, CASE WHEN language = 'python' THEN regexp_matches(l, '^\\s*#') ELSE regexp_matches(l, '^\\s*(//|\\*|/\\*)') END AS remarked FROM hit JOIN pat USING (ordinal)),
n AS (SELECT path, method, n FROM sources JOIN per USING (language)
  UNION ALL SELECT path, 'REGEX', count(*) FROM scored WHERE NOT remarked OR remark >= CASE WHEN language = 'python' THEN 0.20 ELSE 0.22 END GROUP BY path)
SELECT path, method, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS places FROM n""")
def _(spark, sf):
    return repository.scan_repository(sources(spark, sf)).groupBy(F.col("location.file_path").alias("path"), F.col("discovery_method").alias("method")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("emit_seq").alias("places"))


_LONG = "(SELECT doc_id, concat(repeat('AES ', 300), replace(text, chr(10), ' MD5 ')) AS text FROM documents)"


@check("emission_order", f"""
WITH {_PATTERNS}, line AS (SELECT doc_id, text AS l FROM {_LONG} q), ascii AS (SELECT doc_id, {_ASCII.format('l')} AS l FROM line),
hit AS ({_each_pattern('doc_id', 'ascii')})
SELECT CAST(doc_id AS VARCHAR) AS path, count(*) AS n, count(*) AS places FROM hit GROUP BY ALL""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.lit("python").alias("language"),
        F.concat(F.repeat(F.lit("AES "), F.lit(300)), F.replace("text", F.lit("\n"), F.lit(" MD5 "))).alias("text"))
    return repository.scan_patterns(docs).groupBy(F.col("location.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("emit_seq").alias("places"))


# --- files ------------------------------------------------------------------

_HEADS = [("tool", "7F454C4602010100"), ("a.exe", "4D5A90000300"), ("mac", "CFFAEDFE0700"), ("fat.bin", "CAFEBABE00000002"),
          ("A.class", "CAFEBABE00000034"), ("lib.a", "213C617263683E0A"), ("m.py", "696D706F7274"), ("x.tsx", "636F6E7374"),
          ("pom.xml", "3C786D6C3E"), ("notes.txt", "68656C6C6F"), ("requirements.txt", "666C61736B"), (".gitignore", "2A2E6F"),
          ("k.KT", "66756E"), ("lib.so", "00010203"), ("h.hpp", "2F2F"), ("data", "")]
_KIND = {"tool": "binary", "a.exe": "binary", "mac": "binary", "fat.bin": "binary", "A.class": "binary", "lib.a": "binary",
         "m.py": "python", "x.tsx": "typescript", "pom.xml": "manifest", "notes.txt": "unknown", "requirements.txt": "manifest",
         ".gitignore": "unknown", "k.KT": "java", "lib.so": "binary", "h.hpp": "cpp", "data": "unknown"}
_FORMAT = {"tool": "ELF", "a.exe": "PE", "mac": "MACHO", "fat.bin": "MACHO", "lib.a": "ARCHIVE"}
FILES = f"""
SELECT concat('d', o_orderkey % 3, '/', o_orderkey, '-', o_custkey, '/', v.name) AS path, v.name, v.head, length(v.head) AS n
FROM {{orders}} JOIN {values([(i, n, h) for i, (n, h) in enumerate(_HEADS)])} AS v(i, name, head) ON v.i = o_orderkey % {len(_HEADS)}
"""


def typed_files(spark, sf) -> DataFrame:
    df = for_spark(spark, sf, FILES).withColumn("content", F.unhex("head")).withColumn("length", F.col("n").cast("long"))
    return files.with_binary_format(files.with_language(df))


@check("file_types", f"""WITH f AS ({for_duckdb(FILES)}), kind(name, language, binary_format) AS {values([(n, _KIND[n], _FORMAT.get(n, 'UNKNOWN')) for n, _ in _HEADS])}
SELECT path, language, binary_format FROM f JOIN kind USING (name)""")
def _(spark, sf):
    return typed_files(spark, sf).select("path", "language", "binary_format")


@check("files_by_language", f"""WITH f AS ({for_duckdb(FILES)}), kind(name, language) AS {values([(n, _KIND[n]) for n, _ in _HEADS])}
SELECT language, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM f JOIN kind USING (name) WHERE language NOT IN ('binary', 'unknown') GROUP BY 1""")
def _(spark, sf):
    return files.files_by_language(typed_files(spark, sf))


@check("excluded_paths", f"""WITH f AS ({for_duckdb(FILES)}) SELECT path FROM f WHERE NOT list_has_any(string_split(path, '/'), ['d1', 'pom.xml']) AND NOT regexp_matches(path, '\\.(txt|tsx)$')""")
def _(spark, sf):
    return for_spark(spark, sf, FILES).where(~files.excluded(F.col("path"), ["d1", "pom.xml", "*.t[xs]?"])).select("path")


# --- printable strings ------------------------------------------------------

_BYTES = "concat(p_name, chr(1), p_brand, chr(2), p_type, chr(3), 'tiny', chr(4), p_name)"


@check("printable_strings", """
WITH piece AS (SELECT p_partkey, unnest([{'s': p_name, 'o': 0}, {'s': p_brand, 'o': len(p_name) + 1}, {'s': p_type, 'o': len(p_name) + len(p_brand) + 2},
  {'s': p_name, 'o': len(p_name) + len(p_brand) + len(p_type) + 8}]) AS p FROM part)
SELECT p_partkey, p.s AS string, CAST(p.o AS BIGINT) AS byte_offset FROM piece WHERE len(p.s) >= 6""")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.expr(f"encode({_BYTES}, 'UTF-8')").alias("content"))
    return files.printable_strings(df, 6).select("p_partkey", "string", "byte_offset")


# --- binaries ---------------------------------------------------------------

# string, then what it must yield: category, symbol, algorithm, library, score
_STRINGS = [
    ("built with OpenSSL 3.0.2 here", [("LIBRARY", "built with OpenSSL 3.0.2 here", None, "OpenSSL", 0.90)]),
    ("libsodium 1.0.18", [("LIBRARY", "libsodium 1.0.18", None, "libsodium", 0.88)]),
    ("BoringSSL and mbedTLS/2.1", [("LIBRARY", "BoringSSL and mbedTLS/2.1", None, "BoringSSL", 0.88), ("LIBRARY", "BoringSSL and mbedTLS/2.1", None, "mbedTLS", 0.88)]),
    ("TLS_RSA_WITH_AES_128_CBC_SHA", [("PROTOCOL", "TLS_RSA_WITH_AES_128_CBC_SHA", "TLS", None, 0.72), ("PROTOCOL", "TLS_RSA_WITH_AES_128_CBC_SHA", "TLS", None, 0.44)]),
    ("-----BEGIN RSA PRIVATE KEY-----", [("KEY_MATERIAL", "-----BEGIN RSA PRIVATE KEY-----", None, None, 0.90)]),
    ("uses RSA-2048 and AES-256", [("ASYMMETRIC_PKC", "RSA-2048", "RSA", None, 0.396)]),
    ("plain AES.MODE_GCM", [("SYMMETRIC_CIPHER", "AES", "AES", None, 0.341)]),
    ("hmac-sha256 tag", [("HASH_FUNCTION", "sha256", "SHA-256", None, 0.396)]),
    ("kyber inside", [("KEY_EXCHANGE", "kyber", "ML-KEM", None, 0.451)]),
    ("nothing to see", []),
    ("aesthetic describes", []),
    ("bcrypt hash", [("KDF", "bcrypt", "bcrypt", None, 0.396)]),
]
STRINGS = f"""
SELECT concat('bin', l_suppkey % 20) AS path, CAST(l_orderkey AS INT) AS position, v.string, CAST(l_partkey AS BIGINT) AS byte_offset, 'ELF' AS binary_format, v.i
FROM {{lineitem}} JOIN {values([(i, s) for i, (s, _) in enumerate(_STRINGS)])} AS v(i, string) ON v.i = l_partkey % {len(_STRINGS)}
"""
_WANTED = values([(i, *w) for i, (_, ws) in enumerate(_STRINGS) for w in ws])


@check("scan_binary_strings", f"""WITH s AS ({for_duckdb(STRINGS)}), want(i, artifact_category, raw_symbol, suspected_algorithm, library_hint, score) AS {_WANTED}
SELECT path, byte_offset, artifact_category, raw_symbol, suspected_algorithm, library_hint, round(CAST(score AS DOUBLE), 6) AS confidence_score FROM s JOIN want USING (i)""")
def _(spark, sf):
    return binary.scan_binary_strings(for_spark(spark, sf, STRINGS)).select(
        F.col("location.file_path").alias("path"), F.col("location.byte_offset").alias("byte_offset"), "artifact_category", "raw_symbol",
        "suspected_algorithm", "library_hint", F.round("confidence_score", 6).alias("confidence_score"))


_NAMES = ["RSA_new", "RSA_other", "EVP_sha512", "AES_encrypt", "printf", "crypto_sign", "mbedtls_aes_init", "bcrypt", "RSA-2048", "malloc"]
SYMBOLS = f"""
SELECT concat('bin', l_suppkey % 20) AS path, v.symbol, CAST(NULL AS STRING) AS dll, 'ELF' AS binary_format FROM {{lineitem}}
JOIN {values(list(enumerate(_NAMES)))} AS v(i, symbol) ON v.i = l_partkey % {len(_NAMES)} WHERE NOT (l_suppkey % 20 = 3 AND v.i > 1)
"""
_SYMBOL_CTE = f"""
exact(symbol, library, algorithm, confidence) AS {values(_SYM)}, pre(prefix, ordinal, library, algorithm, confidence) AS {values(_PRE)},
sym AS (SELECT DISTINCT path, symbol FROM ({for_duckdb(SYMBOLS)}) q),
byp AS (SELECT symbol, min_by(library, ordinal) AS library, min_by(algorithm, ordinal) AS algorithm, min_by(confidence, ordinal) AS confidence FROM (SELECT DISTINCT symbol FROM sym) n JOIN pre ON starts_with(symbol, prefix) GROUP BY symbol),
known AS (SELECT path, symbol, coalesce(e.library, b.library) AS library, coalesce(e.algorithm, b.algorithm) AS algorithm, CAST(coalesce(e.confidence, b.confidence) AS DOUBLE) AS confidence
  FROM sym LEFT JOIN exact e USING (symbol) LEFT JOIN byp b USING (symbol) WHERE coalesce(e.library, b.library) IS NOT NULL)"""


@check("scan_symbols", f"WITH {_SYMBOL_CTE} SELECT path, symbol AS raw_symbol, library AS library_hint, algorithm AS suspected_algorithm, confidence AS confidence_score FROM known")
def _(spark, sf):
    return binary.scan_symbols(for_spark(spark, sf, SYMBOLS)).select(
        F.col("location.file_path").alias("path"), "raw_symbol", "library_hint", "suspected_algorithm", "confidence_score")


_CORRELATED = f"""{_SYMBOL_CTE}, s AS ({for_duckdb(STRINGS)}), want(i, cat, raw, alg, lib, score) AS {_WANTED},
strings AS (SELECT path, cat, raw, alg, lib, CAST(score AS DOUBLE) AS score FROM s JOIN want USING (i)),
judged AS (SELECT st.*, EXISTS (SELECT 1 FROM known k WHERE k.path = st.path AND k.algorithm = st.alg) AS confirmed,
   (cat = 'LIBRARY' AND score >= 0.80) OR cat IN ('KEY_MATERIAL','CERTIFICATE') AS always FROM strings st WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.path = st.path AND k.symbol = st.raw)),
correlated AS (SELECT path, symbol AS raw_symbol, library AS library_hint, confidence AS score, FALSE AS is_library FROM known
  UNION ALL SELECT path, raw, lib, CASE WHEN NOT always AND confirmed THEN least(score + 0.15, 0.65) ELSE score END, cat = 'LIBRARY' FROM judged WHERE always OR confirmed OR score >= 0.35)"""


@check("correlate", f"WITH {_CORRELATED} SELECT path, raw_symbol, library_hint, round(score, 6) AS confidence_score FROM correlated")
def _(spark, sf):
    by_symbol = binary.scan_symbols(for_spark(spark, sf, SYMBOLS))
    out = binary.correlate(binary.scan_binary_strings(for_spark(spark, sf, STRINGS)), by_symbol)
    return out.select(F.col("location.file_path").alias("path"), "raw_symbol", "library_hint", F.round("confidence_score", 6).alias("confidence_score"))


@check("library_summary", f"""WITH {_CORRELATED} SELECT path, library AS library_hint, concat(library, ' (', count(*), ' crypto symbols found)') AS raw_symbol FROM known k
WHERE NOT EXISTS (SELECT 1 FROM correlated c WHERE c.path = k.path AND c.library_hint = k.library AND c.is_library) GROUP BY path, library HAVING count(*) >= 3""")
def _(spark, sf):
    by_symbol = binary.scan_symbols(for_spark(spark, sf, SYMBOLS))
    strings = for_spark(spark, sf, STRINGS)
    strings = strings.where(F.col("i") >= 3)  # no library strings among these kinds, so that a summary is due
    return binary.library_summary(by_symbol, binary.correlate(binary.scan_binary_strings(strings), by_symbol)).select(
        F.col("location.file_path").alias("path"), "library_hint", "raw_symbol")


# In that query the library strings (kinds 0-2) are left out, so the SQL leaves them out as well.
SQL["library_summary"] = SQL["library_summary"].replace("FROM s JOIN want USING (i)),\njudged", "FROM s JOIN want USING (i) WHERE i >= 3),\njudged")


# --- containers -------------------------------------------------------------

_TREE = [
    ("usr/lib/libssl.so.3", ""), ("usr/lib/libz.so", ""), ("lib64/libgnutls.so.30", ""), ("opt/libssl.so", ""),
    ("etc/ssl/a.pem", "x\n-----BEGIN CERTIFICATE-----\nq\n-----BEGIN RSA PRIVATE KEY-----\n"), ("etc/ssl/readme.md", "-----BEGIN CERTIFICATE-----"),
    ("var/lib/dpkg/status", "Package: openssl\nVersion: 3.0\n\nPackage: zlib\nVersion: 1\n\nPackage: libsodium"),
    ("usr/lib/python3/dist-packages/bcrypt-4.0.dist-info/METADATA", "Name: bcrypt\nVersion: 4.0\n"),
    ("usr/lib/node_modules/jose/package.json", '{"name": "jose", "version": "5.1"}'), ("usr/lib/node_modules/jsonwebtoken/package.json", "not json"),
]
TREE = "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _) in enumerate(_TREE)) + \
    " END AS path, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {_lines(t)}" for i, (_, t) in enumerate(_TREE)) + " END AS text FROM {orders}"
_TREE_SQL = f"tree AS ({for_duckdb(TREE)})"


def tree(spark, sf) -> DataFrame:
    return for_spark(spark, sf, TREE).withColumn("name", F.substring_index("path", "/", -1))


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy(
        F.col("location.file_path").alias("path"), "raw_symbol", "suspected_algorithm", "library_hint",
        F.col("confidence_score").alias("score")).agg(F.count(F.lit(1)).alias("n"))


def _tree_expected(rows: list[tuple], distinct: bool = False) -> str:
    """path of the file, path reported, symbol, algorithm, library, score."""
    n = "least(1, count(*))" if distinct else "count(*)"
    return f"""WITH {_TREE_SQL}, want(at, path, raw_symbol, suspected_algorithm, library_hint, score) AS {values(rows)}
SELECT want.path, raw_symbol, suspected_algorithm, library_hint, CAST(score AS DOUBLE) AS score, CAST({n} AS BIGINT) AS n FROM tree JOIN want ON want.spot = tree.path GROUP BY ALL""".replace("want(at,", "want(spot,")




@check("scan_shared_libs", _tree_expected(
    [("usr/lib/libssl.so.3", "usr/lib/libssl.so.3", "libssl.so.3", a, "OpenSSL", 0.95) for a in ("RSA", "AES", "ECDSA")]
    + [("lib64/libgnutls.so.30", "lib64/libgnutls.so.30", "libgnutls.so.30", None, None, 0.55)]))
def _(spark, sf):
    return _counted(container.scan_shared_libs(tree(spark, sf), container.container_context("image:1"), most=3))


_P = "etc/ssl/a.pem"


@check("scan_tls_config", _tree_expected([
    (_P, _P, "-----BEGIN CERTIFICATE-----", None, None, 0.95), (_P, _P, "-----BEGIN RSA PRIVATE KEY-----", None, None, 0.95),
    (_P, _P, "-----BEGIN CERTIFICATE-----", None, None, 0.93), (_P, _P, "-----BEGIN RSA PRIVATE KEY-----", "RSA", None, 0.97)]))
def _(spark, sf):
    return _counted(container.scan_tls_config(tree(spark, sf), container.container_context("image:1")))


_D = "var/lib/dpkg/status"


@check("scan_dpkg", _tree_expected([(_D, _D, "openssl==3.0", "RSA", "OpenSSL", 0.90), (_D, _D, "libsodium==unknown", "ED25519", "libsodium", 0.90)]))
def _(spark, sf):
    return _counted(container.scan_dpkg(tree(spark, sf), container.container_context("image:1"), most=1))


_B = "usr/lib/python3/dist-packages/bcrypt-4.0.dist-info"


@check("scan_pip", _tree_expected([(_B + "/METADATA", _B, "bcrypt==4.0", "bcrypt", "bcryptjs", 0.83)], True))
def _(spark, sf):
    return _counted(container.scan_pip(tree(spark, sf), container.container_context("image:1"), most=1))


_N = "usr/lib/node_modules/"


@check("scan_npm", _tree_expected([
    (_N + "jose/package.json", _N + "jose/package.json", "jose@5.1", "RSA", "jose", 0.75),
    (_N + "jsonwebtoken/package.json", _N + "jsonwebtoken/package.json", "jsonwebtoken@unknown", "RSA", "jsonwebtoken", 0.77)], True))
def _(spark, sf):
    return _counted(container.scan_npm(tree(spark, sf), container.container_context("image:1"), most=1))


def _all_algorithms(library: str) -> list[str]:
    return next(r["primary_algorithms"] for r in libraries.library_rows() if r["library"] == library)


@check("scan_container", _tree_expected(
    [("usr/lib/libssl.so.3", "usr/lib/libssl.so.3", "libssl.so.3", a, "OpenSSL", 0.95) for a in _all_algorithms("OpenSSL")]
    + [("lib64/libgnutls.so.30", "lib64/libgnutls.so.30", "libgnutls.so.30", None, None, 0.55)]
    + [(_D, _D, "openssl==3.0", a, "OpenSSL", 0.90) for a in _all_algorithms("OpenSSL")]
    + [(_D, _D, "libsodium==unknown", a, "libsodium", 0.90) for a in _all_algorithms("libsodium")]
    + [(_P, _P, "-----BEGIN CERTIFICATE-----", None, None, 0.95), (_P, _P, "-----BEGIN RSA PRIVATE KEY-----", None, None, 0.95),
       (_P, _P, "-----BEGIN CERTIFICATE-----", None, None, 0.93), (_P, _P, "-----BEGIN RSA PRIVATE KEY-----", "RSA", None, 0.97)]))
def _(spark, sf):
    src = tree(spark, sf).where("NOT path LIKE '%node_modules%' AND NOT path LIKE '%dist-packages%'")
    return _counted(container.scan_container(src, container.container_context("image:1")))


# --- scans as records -------------------------------------------------------

SCANS = """
SELECT concat('s', event_id) AS scan_id, ts AS created_at, ts AS started_at, CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL '90' SECOND END AS completed_at,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS error_count, event_id % 7 = 0 AS failed, user_id AS findings, user_id % 3 AS assets, user_id % 5 AS files_scanned
FROM {events}
"""


@check("scan_summary", f"""WITH s AS ({for_duckdb(SCANS)}) SELECT scan_id,
  CASE WHEN failed THEN 'FAILED' WHEN completed_at IS NULL THEN 'RUNNING' WHEN error_count > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
  strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(completed_at, '%Y-%m-%dT%H:%M:%SZ') AS completed_at,
  CASE WHEN completed_at IS NOT NULL THEN 90.0 END AS duration_seconds, strftime(created_at + INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%SZ') AS expires_at,
  CASE WHEN completed_at IS NOT NULL THEN findings END AS findings, CASE WHEN completed_at IS NOT NULL THEN assets END AS assets, CASE WHEN completed_at IS NOT NULL THEN files_scanned END AS files_scanned FROM s""")
def _(spark, sf):
    from keystrata.operators import listing

    return listing.scan_summary(for_spark(spark, sf, SCANS))
