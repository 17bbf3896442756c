"""Checks of the finding stages: lookups, canonical attributes, islands, clusters, assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import FINDING_FACTS, ROW_ID, finding_facts, for_duckdb, for_spark, with_location
from keystrata.dims import algorithms, aliases, apis, libraries, symbols
from keystrata.functions import ids, naming, scoring, text
from keystrata.operators import cluster, listing, lookups, merge, quality, reports
from keystrata.operators.normalize import ATTRIBUTES, normalize
from keystrata.schemas import FINDINGS, conform

QUERIES, SQL = {}, {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def values(rows: list[tuple]) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


# --- lookups ----------------------------------------------------------------

_SPELLINGS = [" RSA ", "rsa_oaep", "Diffie-Hellman", "X25519", "ecc", "EdDSA", "Rijndael", "aes-256-gcm", "DESede", "tdea",
              "XChaCha20", "arcfour", "md5", "SHA_1", "sha2", "Keccak", "pbkdf2-hmac", "argon2id", "hmac-sha256", "SSLv3",
              "TLS1.2", "Kyber", "crystals-dilithium", "SPHINCS+", "blowfish", "", "rsa2048"]


def _spelled(tag: str, names: list[str]) -> str:
    return (f"SELECT {ROW_ID} AS id, v.name FROM {{lineitem}} JOIN {values(list(enumerate(names)))} AS v(i, name) "
            f"ON v.i = l_{tag} % {len(names)}")


@check("resolve_algorithm", f"""
WITH alias(alias, algorithm_key, canonical_name, family) AS {values([(r['alias'], r['algorithm_key'], r['canonical_name'], r['family']) for r in algorithms.alias_rows()])},
input AS ({for_duckdb(_spelled('partkey', _SPELLINGS))})
SELECT id, name, algorithm_key, canonical_name, family FROM input LEFT JOIN alias ON lower(trim(name)) = alias""")
def _(spark, sf):
    df = for_spark(spark, sf, _spelled("partkey", _SPELLINGS))
    return lookups.resolve_algorithm(df, "name").select("id", "name", "algorithm_key", "canonical_name", "family")


_MODULES = ["Crypto.Cipher.AES", "cryptography.hazmat", "cryptographyx", "hashlib", "openssl/evp.h", "openssl/x.h", "openssl",
            "node:crypto", "crypto-js", "crypto-js/aes", "javax.crypto.Cipher", "javax.cryptox", "org.bouncycastle.jce",
            "sodium.h", "sodium/core.h", "mbedtls/aes.h", "jwt", "os", "", "Cryptodome", "crypto/x.y", "ssl.SSLContext"]


@check("match_library", f"""
WITH alias(alias, library, base_confidence) AS {values([(r['alias'], r['library'], r['base_confidence']) for r in libraries.library_alias_rows('import_aliases')])},
input AS ({for_duckdb(_spelled('suppkey', _MODULES))}),
names AS (SELECT DISTINCT name FROM input),
best AS (SELECT name, arg_max(library, CASE WHEN lower(name) = alias THEN 1000 ELSE len(alias) END) AS library,
           arg_max(base_confidence, CASE WHEN lower(name) = alias THEN 1000 ELSE len(alias) END) AS base_confidence
         FROM names JOIN alias ON lower(name) = alias OR (alias LIKE '%/' AND starts_with(lower(name), alias))
           OR starts_with(lower(name), alias || '.') OR starts_with(lower(name), alias || '/') GROUP BY name)
SELECT id, name, library, CAST(base_confidence AS DOUBLE) AS base_confidence FROM input LEFT JOIN best USING (name)""")
def _(spark, sf):
    df = for_spark(spark, sf, _spelled("suppkey", _MODULES))
    return lookups.match_library(df, "name").select("id", "name", "library", "base_confidence")


_PACKAGES = ["openssl", "libssl-dev", "PyCryptodome", "bcrypt", "argon2", "node-jose", "libsodium-dev", "zlib", "crypto", "openssl3"]


@check("match_package", f"""
WITH alias(alias, library) AS {values([(r['alias'], r['library']) for r in libraries.library_alias_rows('package_aliases')])},
input AS ({for_duckdb(_spelled('orderkey', _PACKAGES))})
SELECT id, library FROM input LEFT JOIN alias ON lower(trim(name)) = alias""")
def _(spark, sf):
    return lookups.match_library(for_spark(spark, sf, _spelled("orderkey", _PACKAGES)), "name", "package").select("id", "library")


_OBJECTS = ["libssl.so.3", "libssl.so.1.1.1k", "libcrypto.so.9", "libsodium.so.23.1", "libmbedx509.so.1", "libz.so",
            "LIBEAY32.DLL", "libsslx.so", "bcprov-jdk15on.jar", "libfoo.dylib"]
_SO = [(r["alias"], r["alias_ordinal"], r["library"], r["alias"].split(".so")[0]) for r in libraries.library_alias_rows("shared_objects")]


@check("match_shared_lib", f"""
WITH alias(alias, ordinal, library, stem) AS {values(_SO)},
input AS ({for_duckdb(_spelled('orderkey', _OBJECTS))}),
best AS (SELECT name, arg_min(library, CASE WHEN lower(name) = alias THEN -1 ELSE ordinal END) AS library
         FROM (SELECT DISTINCT name FROM input) n JOIN alias ON lower(name) = alias OR starts_with(lower(name), stem) GROUP BY name)
SELECT id, name, library FROM input LEFT JOIN best USING (name)""")
def _(spark, sf):
    return lookups.match_shared_lib(for_spark(spark, sf, _spelled("orderkey", _OBJECTS)), "name").select("id", "name", "library")


_CALLS = ["AES.new", "foo.new", "new", "x.generate", "hmac.HMAC", "HKDF", "a.b.sha256", "hashlib.md5", "Cipher", "print", "rsa.generate_private_key"]


@check("match_api", f"""
WITH key(k, api_name, algorithm) AS {values([(r['lookup_key'], r['api_name'], r['algorithm']) for r in apis.api_key_rows() if r['language'] == 'python'])},
input AS ({for_duckdb(_spelled('suppkey', _CALLS))})
SELECT id, name, coalesce(a.api_name, b.api_name) AS api_name, coalesce(a.algorithm, b.algorithm) AS api_algorithm
FROM input LEFT JOIN key a ON a.k = lower(name) LEFT JOIN key b ON b.k = regexp_extract(lower(name), '[^.]*$')""")
def _(spark, sf):
    df = for_spark(spark, sf, _spelled("suppkey", _CALLS)).withColumn("language", F.lit("python"))
    return lookups.match_api(df, "language", "name").select("id", "name", "api_name", "api_algorithm")


@check("match_api_qualified", f"""
WITH key(k, api_name) AS {values([(r['lookup_key'], r['api_name']) for r in apis.api_key_rows() if r['language'] == 'python' and r['is_qualified']])},
input AS ({for_duckdb(_spelled('suppkey', _CALLS))})
SELECT id, api_name FROM input LEFT JOIN key ON k = lower(name)""")
def _(spark, sf):
    df = for_spark(spark, sf, _spelled("suppkey", _CALLS)).withColumn("language", F.lit("python"))
    return lookups.match_api(df, "language", "name", qualified_only=True).select("id", "api_name")


_SYMBOLS = ["RSA_new", "RSA_blinding_on", "rsa_new", "EVP_sha512", "EVP_aes_256_gcm", "mbedtls_rsa_pkcs1", "crypto_sign_final",
            "printf", "AES_", "SHA256", "SHA256_Transform", "BCryptEncrypt", "ECDSA_size", "malloc"]
_SYM = [(r["symbol"], r["library"], r["algorithm"], r["confidence"]) for r in symbols.symbol_rows()]
_PRE = [(r["prefix"], r["prefix_ordinal"], r["library"], r["algorithm"], r["confidence"]) for r in symbols.prefix_rows()]


@check("match_symbol", f"""
WITH exact(symbol, library, algorithm, confidence) AS {values(_SYM)}, pre(prefix, ordinal, library, algorithm, confidence) AS {values(_PRE)},
input AS ({for_duckdb(_spelled('partkey', _SYMBOLS))}),
byp AS (SELECT name, min_by(library, ordinal) AS library, min_by(algorithm, ordinal) AS algorithm, min_by(confidence, ordinal) AS confidence
        FROM (SELECT DISTINCT name FROM input) n JOIN pre ON starts_with(name, prefix) GROUP BY name)
SELECT id, name, coalesce(e.library, b.library) AS library, coalesce(e.algorithm, b.algorithm) AS algorithm,
  CAST(coalesce(e.confidence, b.confidence) AS DOUBLE) AS confidence
FROM input LEFT JOIN exact e ON e.symbol = name LEFT JOIN byp b USING (name)""")
def _(spark, sf):
    return lookups.match_symbol(for_spark(spark, sf, _spelled("partkey", _SYMBOLS)), "name").select(
        "id", "name", "library", "algorithm", "confidence")


# --- canonical attributes ---------------------------------------------------

# raw symbol, suspected, category, key hint, mode hint, curve hint, library hint
_RAW = [
    ("RSA.generate(2048)", "RSA", "ASYMMETRIC_PKC", None, None, None, "pycryptodome"),
    ("AES.new", "AES", "SYMMETRIC_CIPHER", None, "MODE_CBC", None, "Cryptodome"),
    ('Cipher.getInstance("AES/GCM/NoPadding"', "AES", "SYMMETRIC_CIPHER", None, None, None, "javax.crypto"),
    ('Cipher.getInstance("RSA/ECB/PKCS1Padding"', "RSA", "ASYMMETRIC_PKC", 1024, None, None, None),
    ("x", "DES/CBC", "SYMMETRIC_CIPHER", None, None, None, None),
    ("#include <openssl/evp.h>", None, "LIBRARY", None, None, None, "OpenSSL 3.0"),
    ("EVP_aes_256_gcm()", "AES", "SYMMETRIC_CIPHER", None, None, None, None),
    ("EVP_aes_128_cbc", None, "SYMMETRIC_CIPHER", None, "gcm", None, "libssl3-dev"),
    ("EVP_sha256", None, "HASH_FUNCTION", None, None, None, "libcrypto"),
    ("EVP_sha3_512", "SHA", "HASH_FUNCTION", None, None, None, None),
    ("EVP_PKEY_EC", None, "ASYMMETRIC_PKC", None, None, None, None),
    ("EVP_DecryptInit_ex(", "AES", "SYMMETRIC_CIPHER", None, None, None, None),
    ("EVP_md5", "EVP_md5", "HASH_FUNCTION", None, None, None, None),
    ("AES-256-CTR", "aes-256-ctr", "SYMMETRIC_CIPHER", None, None, None, None),
    ("aes128", "aes128", "SYMMETRIC_CIPHER", None, None, None, "weirdlib"),
    ("aes192cbc", "AES192CBC", "SYMMETRIC_CIPHER", None, None, None, None),
    ("AES-SIV", "AES-SIV", "SYMMETRIC_CIPHER", None, None, None, None),
    ("RSA-4096", "RSA-4096", "DIGITAL_SIGNATURE", None, None, None, None),
    ("RSA_sign_pss", "rsassa", "DIGITAL_SIGNATURE", None, None, None, "crypto"),
    ("dh 3072", "Diffie-Hellman", "KEY_EXCHANGE", None, None, None, None),
    ("ec.generate", "ECDSA", "ASYMMETRIC_PKC", None, None, "P-384", "cryptography"),
    ("curve prime256v1", "ECDSA", "ASYMMETRIC_PKC", None, None, None, None),
    ("use secp256k1 and ed25519", "ECDSA", "DIGITAL_SIGNATURE", None, None, None, None),
    ("k", "x25519", "KEY_EXCHANGE", None, None, None, "sodium"),
    ("k", "ed25519", "DIGITAL_SIGNATURE", None, None, None, None),
    ("k", "secp521r1", "DIGITAL_SIGNATURE", None, None, "mycurve", None),
    ("sha224", "sha224", "HASH_FUNCTION", None, None, None, "hashlib"),
    ("SHA512", "SHA512", "HASH_FUNCTION", None, None, None, "hashlib"),
    ("hmac", "hmac_sha256", "MAC", None, None, None, "hmac"),
    ("PBKDF2", "PBKDF2", "KDF", None, None, None, None),
    ("kyber", "kyber", "KEY_EXCHANGE", None, None, None, None),
    ("ml", "ML-KEM-1024", "KEY_EXCHANGE", None, None, None, None),
    ("slh", "SLH_DSA_SHA2", "DIGITAL_SIGNATURE", None, None, None, None),
    ("tls", "tls_v1_2", "PROTOCOL", None, None, None, None),
    ("SSLv3", "sslv3", "PROTOCOL", None, None, None, None),
    ("use_SSH_now", None, "PROTOCOL", None, None, None, None),
    ("-----BEGIN CERTIFICATE-----", None, "CERTIFICATE", None, None, None, None),
    ("-----BEGIN PRIVATE KEY-----", None, "KEY_MATERIAL", None, None, None, None),
    ("import bcrypt", None, "LIBRARY", None, None, None, "bcrypt"),
    ("urandom", None, "RANDOM", None, None, None, None),
    ("my_bcrypt_fn", None, "KDF", None, None, None, None),
    ("hmac_of", None, "MAC", None, None, None, None),
    ("what", None, "UNKNOWN", None, None, None, None),
    ("foo", "Foo_Bar-Baz", "SYMMETRIC_CIPHER", None, None, None, None),
    ("libssl.so.3", "RSA", "LIBRARY", None, None, None, "OpenSSL"),
    ("RSA.generate", "RSA", "ASYMMETRIC_PKC", 4096, None, None, "node-forge"),
    ("chacha", "ChaCha20-Poly1305", "SYMMETRIC_CIPHER", None, None, None, "node:crypto"),
    ("triple", "TripleDES", "SYMMETRIC_CIPHER", None, "ede", None, None),
]
RAW_FACTS = f"""
SELECT {ROW_ID} AS finding_id, l_orderkey AS emit_seq, concat('./SRC', l_suppkey % 10, '\\\\Mod', l_partkey % 50, '.py') AS file_path,
  v.raw_symbol, v.suspected_algorithm, v.artifact_category, CAST(v.key_size_hint AS INT) AS key_size_hint,
  CAST(v.mode_hint AS STRING) AS mode_hint, CAST(v.curve_hint AS STRING) AS curve_hint, v.library_hint
FROM {{lineitem}} JOIN {values([(i, *r) for i, r in enumerate(_RAW)])}
  AS v(i, raw_symbol, suspected_algorithm, artifact_category, key_size_hint, mode_hint, curve_hint, library_hint) ON v.i = l_partkey % {len(_RAW)}
"""

_T3 = "([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)"
_T2 = "([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)"
_LIBS = sorted(aliases.LIBRARIES.items(), key=lambda kv: -len(kv[0]))
_LIB_CASE = "CASE " + " ".join(f"WHEN lib = '{a}' THEN '{c}'" for a, c in _LIBS) + " " + " ".join(
    f"WHEN contains(lib, '{a}') THEN '{c}'" for a, c in _LIBS) + " WHEN lib = 'crypto' THEN 'Node.js crypto' ELSE library_hint END"
_CURVE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(raw_symbol, '(?i)\\b{a}\\b') THEN '{c}'" for a, c in aliases.CURVES.items()) + " END"

# Canonical attributes per distinct raw form, from relation `raws`.
NORMALIZED_SQL = f"""
alias(alias, algorithm_key, canonical_name, family) AS {values([(r['alias'], r['algorithm_key'], r['canonical_name'], r['family']) for r in algorithms.alias_rows()])},
curves(alias, curve) AS {values(list(aliases.CURVES.items()))},
pads(alias, pad) AS {values(list(aliases.PADDINGS.items()))},
n0 AS (SELECT *, lower(library_hint) AS lib, CASE WHEN artifact_category = 'LIBRARY' THEN NULL
     WHEN regexp_matches(raw_symbol, '{_T2}') THEN raw_symbol WHEN regexp_matches(suspected_algorithm, '{_T2}') THEN suspected_algorithm END AS slashed
     FROM (SELECT DISTINCT raw_symbol, suspected_algorithm, artifact_category, key_size_hint, mode_hint, curve_hint, library_hint FROM raws) d),
n1 AS (SELECT *, CASE WHEN regexp_matches(slashed, '{_T3}') THEN regexp_extract(slashed, '{_T3}', 1) WHEN slashed IS NOT NULL THEN regexp_extract(slashed, '{_T2}', 1) END AS f_alg,
     CASE WHEN regexp_matches(slashed, '{_T3}') THEN regexp_extract(slashed, '{_T3}', 2) WHEN slashed IS NOT NULL THEN regexp_extract(slashed, '{_T2}', 2) END AS f_mode,
     CASE WHEN regexp_matches(slashed, '{_T3}') THEN regexp_extract(slashed, '{_T3}', 3) END AS f_pad FROM n0),
n2 AS (SELECT *, coalesce(f_alg, suspected_algorithm) AS s1,
     CASE WHEN contains(raw_symbol, 'EVP_') THEN raw_symbol WHEN contains(coalesce(f_alg, suspected_algorithm), 'EVP_') THEN coalesce(f_alg, suspected_algorithm) END AS e FROM n1),
n3 AS (SELECT *, nullif(regexp_extract(e, '(?i)EVP_aes_([0-9]{{3}})_([a-z0-9]+)', 1), '') AS e_bits, nullif(upper(regexp_extract(e, '(?i)EVP_aes_([0-9]{{3}})_([a-z0-9]+)', 2)), '') AS e_mode,
     nullif(upper(regexp_extract(e, '(?i)EVP_(sha[0-9]+|sha3_[0-9]+|md5)', 1)), '') AS e_hash FROM n2),
n4 AS (SELECT *, CASE WHEN e_bits IS NOT NULL THEN 'AES-' || e_bits || '-' || e_mode WHEN e_hash LIKE 'SHA%' THEN 'SHA-' || substr(e_hash, 4)
     WHEN e_hash IS NOT NULL THEN e_hash WHEN upper(e) LIKE '%RSA%' THEN 'RSA' WHEN upper(e) LIKE '%EC%' THEN 'ECDSA' END AS e_alg FROM n3),
n5 AS (SELECT *, CASE WHEN e_alg IS NOT NULL AND (s1 IS NULL OR upper(s1) LIKE 'EVP%' OR upper(s1) IN ('AES','SHA','RSA','HASH')) THEN e_alg ELSE s1 END AS s2 FROM n4),
n6 AS (SELECT *, replace(s2, '_', '-') AS h FROM n5),
n7 AS (SELECT *, CASE WHEN regexp_matches(h, '(?i)^AES-(128|192|256)(-[A-Z0-9]+)?$') OR regexp_matches(h, '(?i)^AES(128|192|256)([A-Z]{{2,4}})?$') OR regexp_matches(h, '(?i)^AES-[A-Z]{{3,4}}$') THEN 'AES'
       WHEN regexp_matches(h, '(?i)^RSA-(512|1024|2048|3072|4096|7680|15360)$') THEN 'RSA' WHEN regexp_matches(h, '(?i)^SHA[0-9]{{3}}$') THEN 'SHA-' || right(h, 3) ELSE s2 END AS s3,
     CASE WHEN regexp_matches(h, '(?i)^AES-?(128|192|256)') THEN CAST(regexp_extract(h, '[0-9]{{3}}') AS INT) WHEN regexp_matches(h, '(?i)^RSA-(512|1024|2048|3072|4096|7680|15360)$') THEN CAST(regexp_extract(h, '[0-9]+') AS INT) END AS n_key,
     nullif(upper(CASE WHEN regexp_matches(h, '(?i)^AES-(128|192|256)-[A-Z0-9]+$') THEN regexp_extract(h, '[^-]*$') WHEN regexp_matches(h, '(?i)^AES(128|192|256)[A-Z]{{2,4}}$') THEN substr(h, 7)
       WHEN regexp_matches(h, '(?i)^AES-[A-Z]{{3,4}}$') THEN substr(h, 5) END), '') AS n_mode FROM n6),
n8 AS (SELECT n7.*, coalesce(regexp_replace(upper(mode_hint), '^MODE_', ''), upper(f_mode), e_mode, n_mode) AS mode, coalesce(pads.pad, f_pad) AS padding,
     coalesce(key_size_hint, CAST(e_bits AS INT), n_key, CASE WHEN regexp_matches(upper(s3), 'RSA|DSA|DH') THEN CAST(nullif(regexp_extract(raw_symbol, '\\b(512|1024|2048|3072|4096)\\b', 1), '') AS INT) END) AS key_length_bits,
     coalesce(CASE WHEN curve_hint IS NOT NULL THEN coalesce(c1.curve, curve_hint) ELSE {_CURVE_CASE} END, c2.curve) AS curve,
     CASE WHEN c2.curve IS NULL THEN replace(s3, '_', '-') WHEN lower(s3) = 'x25519' OR lower(s3) = 'curve25519' THEN 'ECDH' WHEN lower(s3) = 'ed25519' OR lower(s3) = 'edwards25519' THEN 'Ed25519' ELSE 'ECDSA' END AS clean,
     {_LIB_CASE} AS implementation_library
     FROM n7 LEFT JOIN pads ON pads.alias = lower(f_pad) LEFT JOIN curves c1 ON c1.alias = lower(curve_hint) LEFT JOIN curves c2 ON c2.alias = lower(s3)),
n9 AS (SELECT n8.*, upper(raw_symbol) AS ur, upper(clean) AS uc, a.algorithm_key, a.canonical_name, a.family AS a_family,
     concat_ws('-', 'AES', CAST(key_length_bits AS VARCHAR), mode) AS aes FROM n8 LEFT JOIN alias a ON a.alias = lower(clean)),
n10 AS (SELECT *, CASE WHEN algorithm_key = 'AES' THEN aes WHEN algorithm_key IS NOT NULL THEN canonical_name
     WHEN clean IS NULL THEN CASE WHEN artifact_category = 'CERTIFICATE' THEN 'X.509 Certificate' WHEN artifact_category = 'KEY_MATERIAL' THEN 'Cryptographic Key Material'
       WHEN artifact_category = 'LIBRARY' THEN 'Library: ' || coalesce(implementation_library, 'Cryptographic Library') WHEN artifact_category = 'RANDOM' THEN 'CSPRNG'
       WHEN artifact_category = 'PROTOCOL' AND ur LIKE '%TLS%' THEN 'TLS' WHEN artifact_category = 'PROTOCOL' AND ur LIKE '%SSH%' THEN 'SSH' WHEN artifact_category = 'PROTOCOL' AND ur LIKE '%SSL%' THEN 'SSL'
       WHEN ur LIKE '%RSA%' THEN 'RSA' WHEN ur LIKE '%AES%' AND key_length_bits IS NOT NULL AND mode IS NOT NULL THEN aes WHEN ur LIKE '%AES%' THEN 'AES'
       WHEN ur LIKE '%SHA256%' OR ur LIKE '%SHA-256%' THEN 'SHA-256' WHEN ur LIKE '%HMAC%' THEN 'HMAC' WHEN ur LIKE '%PBKDF2%' THEN 'PBKDF2' WHEN ur LIKE '%BCRYPT%' THEN 'bcrypt'
       WHEN ur LIKE '%SECP256R1%' OR ur LIKE '%PRIME256V1%' THEN 'ECDSA' ELSE 'Unknown Algorithm' END
     WHEN uc LIKE 'ML-KEM%' THEN 'ML-KEM' WHEN uc LIKE 'ML-DSA%' THEN 'ML-DSA' WHEN uc LIKE 'SLH-DSA%' THEN 'SLH-DSA'
     WHEN uc LIKE 'SHA-%' OR uc LIKE 'SHA3%' THEN clean WHEN uc LIKE 'TLS%' THEN 'TLS' WHEN uc LIKE 'SSL%' THEN 'SSL' ELSE clean END AS algorithm FROM n9),
n11 AS (SELECT *, CASE WHEN algorithm_key IS NOT NULL THEN a_family
     WHEN clean IS NULL THEN CASE WHEN artifact_category IN ('CERTIFICATE','KEY_MATERIAL','LIBRARY','RANDOM') THEN artifact_category
       WHEN artifact_category = 'PROTOCOL' AND algorithm IN ('TLS','SSH','SSL') THEN 'PROTOCOL' WHEN algorithm LIKE 'AES%' THEN 'AES' WHEN algorithm = 'SHA-256' THEN 'SHA'
       WHEN algorithm = 'HMAC' THEN 'MAC' WHEN algorithm IN ('PBKDF2','bcrypt') THEN 'KDF' WHEN algorithm = 'ECDSA' THEN 'ECC' WHEN algorithm = 'RSA' THEN 'RSA' END
     WHEN algorithm IN ('ML-KEM','ML-DSA','SLH-DSA') THEN algorithm WHEN uc LIKE 'SHA-%' OR uc LIKE 'SHA3%' THEN 'SHA' WHEN uc LIKE 'TLS%' OR uc LIKE 'SSL%' THEN 'PROTOCOL'
     ELSE regexp_extract(uc, '^[^-]*') END AS algorithm_family FROM n10),
canon AS (SELECT *, CASE WHEN artifact_category IN ('LIBRARY','CERTIFICATE','KEY_MATERIAL','RANDOM') THEN artifact_category
     WHEN artifact_category = 'PROTOCOL' OR algorithm_family = 'PROTOCOL' OR algorithm IN ('TLS','SSL','SSH') THEN 'PROTOCOL'
     WHEN algorithm_family IN ('AES','DES','3DES','RC4') OR algorithm_family LIKE '%CHACHA%' THEN 'SYMMETRIC_CIPHER'
     WHEN algorithm_family IN ('SHA','MD5') OR upper(algorithm) LIKE '%SHA-%' THEN 'HASH_FUNCTION'
     WHEN algorithm_family LIKE '%MAC%' THEN 'MAC' WHEN algorithm_family IN ('PBKDF2','BCRYPT','SCRYPT','ARGON2','HKDF') THEN 'KDF'
     WHEN algorithm IN ('ECDH','DH','ML-KEM') THEN 'KEY_EXCHANGE' WHEN upper(algorithm) IN ('ECDSA','ED25519','DSA','ML-DSA','SLH-DSA') THEN 'DIGITAL_SIGNATURE'
     WHEN algorithm_family = 'RSA' AND (ur LIKE '%SIGN%' OR ur LIKE '%PSS%') THEN 'DIGITAL_SIGNATURE' WHEN algorithm_family = 'RSA' OR artifact_category = 'ASYMMETRIC_PKC' THEN 'ASYMMETRIC_ENCRYPTION'
     WHEN artifact_category IN ('SYMMETRIC_CIPHER','HASH_FUNCTION','DIGITAL_SIGNATURE','KEY_EXCHANGE') THEN artifact_category ELSE 'UNKNOWN' END AS primitive_type FROM n11)
"""
_ATTRS = ", ".join(f"c.{a}" for a in ATTRIBUTES)
_RAW_JOIN = """raws r JOIN canon c ON c.raw_symbol = r.raw_symbol AND c.suspected_algorithm IS NOT DISTINCT FROM r.suspected_algorithm
  AND c.artifact_category = r.artifact_category AND c.key_size_hint IS NOT DISTINCT FROM r.key_size_hint AND c.mode_hint IS NOT DISTINCT FROM r.mode_hint
  AND c.curve_hint IS NOT DISTINCT FROM r.curve_hint AND c.library_hint IS NOT DISTINCT FROM r.library_hint"""


def raw_findings(spark: SparkSession, sf: str) -> DataFrame:
    return conform(with_location(for_spark(spark, sf, RAW_FACTS).withColumn("start_line", F.lit(None).cast("int"))), FINDINGS)


_RAW_DUCK = for_duckdb(RAW_FACTS).replace("'\\\\Mod'", "'\\Mod'")


@check("normalize", f"WITH raws AS ({_RAW_DUCK}), {NORMALIZED_SQL} SELECT r.finding_id, {_ATTRS} FROM {_RAW_JOIN}")
def _(spark, sf):
    return normalize(raw_findings(spark, sf)).select("finding_id", *ATTRIBUTES)


@check("norm_path", f"""
WITH raws AS ({_RAW_DUCK}) SELECT finding_id, lower(regexp_replace(trim(replace(file_path, '\\', '/')), '^\\./', '')) AS path_key FROM raws""")
def _(spark, sf):
    return raw_findings(spark, sf).select("finding_id", text.norm_path(F.col("location.file_path")).alias("path_key"))


@check("parse_transformation", f"""
WITH raws AS ({_RAW_DUCK}) SELECT finding_id, CASE WHEN regexp_matches(raw_symbol, '{_T3}') THEN regexp_extract(raw_symbol, '{_T3}', 1) ELSE nullif(regexp_extract(raw_symbol, '{_T2}', 1), '') END AS algorithm,
  upper(CASE WHEN regexp_matches(raw_symbol, '{_T3}') THEN regexp_extract(raw_symbol, '{_T3}', 2) ELSE nullif(regexp_extract(raw_symbol, '{_T2}', 2), '') END) AS mode FROM raws""")
def _(spark, sf):
    form = naming.parse_transformation(F.col("raw_symbol"))
    return raw_findings(spark, sf).select("finding_id", form["algorithm"].alias("algorithm"), form["mode"].alias("mode"))


# --- findings of the cluster checks -----------------------------------------


def findings(spark: SparkSession, sf: str) -> DataFrame:
    facts = with_location(finding_facts(spark, sf))
    return conform(facts.withColumn("raw_symbol", F.lit("")).withColumn("confidence_rationale", F.col("finding_id")), FINDINGS)


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize(findings(spark, sf))


FACTS = f"facts AS ({for_duckdb(FINDING_FACTS)})"
NORM = FACTS + """,
named(suspected_algorithm, algorithm, fam, prim, k, m, c) AS (VALUES ('RSA','RSA','RSA','ASYMMETRIC_ENCRYPTION',NULL,NULL,NULL),
  ('aes-256-gcm','AES-256-GCM','AES','SYMMETRIC_CIPHER',256,'GCM',NULL), ('AES_128_CBC','AES-128-CBC','AES','SYMMETRIC_CIPHER',128,'CBC',NULL),
  ('sha256','SHA-256','SHA','HASH_FUNCTION',NULL,NULL,NULL), ('MD5','MD5','MD5','HASH_FUNCTION',NULL,NULL,NULL), ('ecdsa','ECDSA','ECC','DIGITAL_SIGNATURE',NULL,NULL,NULL),
  ('x25519','ECDH','ECC','KEY_EXCHANGE',NULL,NULL,'Curve25519'), ('3DES','3DES','3DES','SYMMETRIC_CIPHER',NULL,NULL,NULL), ('hmac','HMAC','HMAC','MAC',NULL,NULL,NULL),
  ('PBKDF2','PBKDF2','PBKDF2','KDF',NULL,NULL,NULL), ('kyber','ML-KEM','ML-KEM','KEY_EXCHANGE',NULL,NULL,NULL), ('tlsv1','TLS','TLS','PROTOCOL',NULL,NULL,NULL),
  ('des','DES','DES','SYMMETRIC_CIPHER',NULL,NULL,NULL), ('SHA512','SHA-512','SHA','HASH_FUNCTION',NULL,NULL,NULL)),
norm AS (SELECT f.*, n.algorithm, n.fam, n.prim, coalesce(key_size_hint, k) AS key, m AS mode,
    CASE WHEN curve_hint IS NOT NULL THEN CASE curve_hint WHEN 'prime256v1' THEN 'secp256r1' ELSE curve_hint END ELSE c END AS curve,
    CASE library_hint WHEN 'libssl3-dev' THEN 'OpenSSL' ELSE library_hint END AS library,
    row_number() OVER (PARTITION BY file_path ORDER BY emit_seq, finding_id) AS rn
  FROM facts f JOIN named n USING (suspected_algorithm))"""

_COMPATIBLE = """(e.fam = i.fam AND (e.alg = i.alg OR e.alg = e.fam OR i.alg = e.fam OR starts_with(e.alg, i.alg) OR starts_with(i.alg, e.alg)
  OR (starts_with(e.alg, e.fam) AND starts_with(i.alg, e.fam))) AND coalesce(e.key = i.key, TRUE) AND coalesce(e.mode = i.mode, TRUE)
  AND coalesce(e.curve = i.curve, TRUE) AND abs(e.line - i.line) <= 2)"""
# First fit as a recursion that takes every path's next finding in each step.
FIT = f"""
item AS (SELECT file_path, rn, finding_id, {{'fam': fam, 'alg': upper(algorithm), 'key': key, 'mode': mode, 'curve': lower(curve), 'line': start_line}} AS i FROM norm),
fit(file_path, rn, finding_id, leaders, members, slot) AS (
  SELECT file_path, rn, finding_id, [finding_id], [[i]], CAST(1 AS BIGINT) FROM item WHERE rn = 1
  UNION ALL
  SELECT file_path, rn, finding_id,
    CASE WHEN spot IS NULL THEN list_append(leaders, finding_id) ELSE leaders END,
    CASE WHEN spot IS NULL THEN list_append(members, [i]) ELSE list_transform(members, lambda m, n: CASE WHEN n = spot THEN list_append(m, i) ELSE m END) END,
    CAST(coalesce(spot, len(leaders) + 1) AS BIGINT)
  FROM (SELECT f.file_path, t.rn, t.finding_id, t.i, f.leaders, f.members,
          list_position(list_transform(f.members, lambda m: len(list_filter(m, lambda e: NOT {_COMPATIBLE.replace('i.', 't.i.')})) = 0), TRUE) AS spot
        FROM fit f JOIN item t ON t.file_path = f.file_path AND t.rn = f.rn + 1) step),
placed AS (SELECT n.*, fit.leaders[fit.slot] AS leader_id FROM fit JOIN norm n USING (file_path, rn))"""


@check("line_islands", f"""WITH {NORM},
line AS (SELECT DISTINCT file_path, fam, start_line AS line FROM norm),
step AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY file_path, fam ORDER BY line) <= 2 THEN 0 ELSE 1 END AS fresh FROM line),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path, fam ORDER BY line) AS g FROM step)
SELECT file_path, fam AS family, line, CAST(min(line) OVER (PARTITION BY file_path, fam, g) AS INT) AS island FROM run""")
def _(spark, sf):
    lines = normalized(spark, sf).select(
        F.col("location.file_path").alias("file_path"), F.col("algorithm_family").alias("family"),
        F.col("location.start_line").alias("line")).distinct()
    return cluster.line_islands(lines, ["file_path", "family"])


@check("first_fit_clusters", f"WITH RECURSIVE {NORM}, {FIT} SELECT finding_id, leader_id FROM placed")
def _(spark, sf):
    found = cluster.assign_clusters(normalized(spark, sf))
    return found.profiled.join(found.clusters, ["path_key", "profile_id"]).select("finding_id", "leader_id")


def boundless(spark: SparkSession, sf: str) -> DataFrame:
    """The findings, some of them without a line and some from binaries, in every path."""
    found = normalized(spark, sf)
    line = F.when(F.col("emit_seq") % 11 != 0, F.col("location.start_line"))
    return found.withColumns({"location": F.col("location").withField("start_line", line), "binary_format": F.when(F.col("emit_seq") % 13 == 0, "ELF")})


_FREE = FIT.replace("'line': start_line}", "'line': CASE WHEN emit_seq % 11 <> 0 AND emit_seq % 13 <> 0 THEN start_line END}").replace(
    "abs(e.line - t.i.line) <= 2", "(e.line IS NULL OR t.i.line IS NULL OR abs(e.line - t.i.line) <= 2)")


@check("first_fit_boundless", f"WITH RECURSIVE {NORM}, {_FREE} SELECT finding_id, leader_id FROM placed")
def _(spark, sf):
    found = cluster.assign_clusters(boundless(spark, sf))
    return found.profiled.join(found.clusters, ["path_key", "profile_id"]).select("finding_id", "leader_id")


_NS = ids.ASSET_NAMESPACE.hex
ASSETS = f"""
clustered AS (SELECT file_path, leader_id, count(*) AS finding_count,
    arg_min(algorithm, (-len(algorithm), rn)) AS algorithm, arg_min(fam, rn) AS algorithm_family, arg_min(prim, rn) AS primitive_type,
    min_by(key, rn) FILTER (WHERE key IS NOT NULL) AS key_length_bits, min_by(mode, rn) FILTER (WHERE mode IS NOT NULL) AS mode,
    min_by(curve, rn) FILTER (WHERE curve IS NOT NULL) AS curve, min_by(library, rn) FILTER (WHERE library IS NOT NULL) AS implementation_library,
    arg_min(start_line, (-confidence_score, rn)) AS start_line,
    CASE WHEN count(*) = 1 THEN round(max(confidence_score), 4) ELSE least(1.0, round(max(confidence_score) + 0.05 * (sum(confidence_score) - max(confidence_score)), 4)) END AS confidence_score,
    string_agg(DISTINCT discovery_method, ',' ORDER BY discovery_method) AS methods FROM placed GROUP BY file_path, leader_id),
seeded AS (SELECT *, sha1(unhex('{_NS}') || encode('path:' || lower(file_path) || '|line:' || start_line || '|alg:' || upper(algorithm) || '|key:' || coalesce(CAST(key_length_bits AS VARCHAR), 'none')
    || '|mode:' || upper(coalesce(mode, 'none')) || '|curve:' || lower(coalesce(curve, 'none')) || '|lib:' || lower(coalesce(implementation_library, 'none')))) AS d FROM clustered),
asset AS (SELECT concat(substr(d, 1, 8), '-', substr(d, 9, 4), '-5', substr(d, 14, 3), '-', substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(d, 17, 1)), 1), substr(d, 18, 3), '-', substr(d, 21, 12)) AS asset_id,
    *, CASE WHEN confidence_score >= 0.85 THEN 'VERY_HIGH' WHEN confidence_score >= 0.70 THEN 'HIGH' WHEN confidence_score >= 0.45 THEN 'MEDIUM' WHEN confidence_score >= 0.20 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence_level FROM seeded)"""
_ASSET_COLUMNS = "algorithm, algorithm_family, primitive_type, key_length_bits, mode, curve, implementation_library, start_line, finding_count, confidence_score, confidence_level"


@check("merge_clusters", f"WITH RECURSIVE {NORM}, {FIT}, {ASSETS} SELECT asset_id, leader_id, methods, {_ASSET_COLUMNS} FROM asset")
def _(spark, sf):
    assets, _ = merge.build_assets(normalized(spark, sf))
    return assets.select(
        "asset_id", "leader_id", F.array_join("discovery_methods", ",").alias("methods"),
        F.col("location.start_line").alias("start_line"), *[c for c in _ASSET_COLUMNS.split(", ") if c != "start_line"])


@check("asset_evidence", f"WITH RECURSIVE {NORM}, {FIT}, {ASSETS} SELECT a.asset_id, p.finding_id, p.discovery_method FROM placed p JOIN asset a USING (file_path, leader_id)")
def _(spark, sf):
    _, evidence = merge.build_assets(normalized(spark, sf))
    return evidence.select("asset_id", "finding_id", "discovery_method")


@check("asset_metadata", f"""WITH RECURSIVE {NORM}, {FIT}, {ASSETS}
SELECT DISTINCT a.asset_id, v.attribute, v.value FROM placed p JOIN asset a USING (file_path, leader_id),
  LATERAL (SELECT 'discovery_method' AS attribute, p.discovery_method AS value UNION ALL SELECT 'scanner', p.scanner_name) v""")
def _(spark, sf):
    _, evidence = merge.build_assets(normalized(spark, sf))
    return merge.asset_metadata(evidence)


@check("parent_asset", f"WITH RECURSIVE {NORM}, {FIT}, {ASSETS} SELECT p.finding_id, a.asset_id FROM placed p JOIN asset a USING (file_path, leader_id) WHERE p.discovery_method = 'AST'")
def _(spark, sf):
    _, evidence = merge.build_assets(normalized(spark, sf))
    return merge.parent_asset(findings(spark, sf).where(F.col("discovery_method") == "AST"), evidence)


@check("normalization_stats", f"""WITH RECURSIVE {NORM}, {FIT}
SELECT count(*) AS raw_findings_count, count(DISTINCT leader_id) AS assets_produced_count, count(*) - count(DISTINCT leader_id) AS findings_merged_count,
  round((count(*) - count(DISTINCT leader_id)) / count(*), 4) AS merge_ratio FROM placed""")
def _(spark, sf):
    base = normalized(spark, sf)
    assets, _ = merge.build_assets(base)
    return reports.normalization_stats(findings(spark, sf), assets)


@check("compatible", f"""WITH {NORM},
pair AS (SELECT finding_id, {{'fam': fam, 'alg': upper(algorithm), 'key': key, 'mode': mode, 'curve': lower(curve), 'line': start_line}} AS e,
  lead({{'fam': fam, 'alg': upper(algorithm), 'key': key, 'mode': mode, 'curve': lower(curve), 'line': start_line}}) OVER (PARTITION BY file_path, start_line ORDER BY finding_id) AS i FROM norm)
SELECT finding_id, {_COMPATIBLE} AS fits FROM pair WHERE i IS NOT NULL""")
def _(spark, sf):
    from pyspark.sql import Window as W

    df = cluster.with_profile(normalized(spark, sf))
    df = df.select("path_key", "finding_id", "line", F.struct(*[c.alias(n) for n, c in cluster.shape_columns().items()]).alias("e"))
    nxt = F.lead("e").over(W.partitionBy("path_key", "line").orderBy("finding_id"))
    df = df.withColumn("i", nxt).where(F.col("i").isNotNull())
    return df.select("finding_id", cluster.compatible(F.col("e"), F.col("i")).alias("fits"))


@check("confidence", f"""WITH {FACTS}, grouped AS (
SELECT file_path, suspected_algorithm, count(*) AS finding_count,
  least(1.0, round(max(confidence_score) + 0.05 * (sum(confidence_score) - max(confidence_score)), 4)) AS confidence_score,
  string_agg(DISTINCT discovery_method, ',' ORDER BY discovery_method) AS methods FROM facts GROUP BY 1, 2)
SELECT *, CASE WHEN confidence_score >= 0.85 THEN 'VERY_HIGH' WHEN confidence_score >= 0.70 THEN 'HIGH' WHEN confidence_score >= 0.45 THEN 'MEDIUM' WHEN confidence_score >= 0.20 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence_level FROM grouped""")
def _(spark, sf):
    return merge.confidence(finding_facts(spark, sf), ["file_path", "suspected_algorithm"])


@check("detection_confidence", f"""WITH {FACTS} SELECT finding_id,
  round(least(0.98, 0.90 + CASE WHEN library_hint IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN key_size_hint IS NOT NULL THEN 0.03 ELSE 0 END + 0.02), 4) AS parsed,
  round(least(0.75, confidence_score + CASE WHEN key_size_hint IS NOT NULL THEN 0.03 ELSE 0 END), 4) AS matched FROM facts""")
def _(spark, sf):
    has_key, has_lib = F.col("key_size_hint").isNotNull(), F.col("library_hint").isNotNull()
    return finding_facts(spark, sf).select(
        "finding_id",
        scoring.detection_confidence("ast_api_call", None, has_lib, has_key, True).alias("parsed"),
        scoring.detection_confidence("regex_executable", F.col("confidence_score"), has_lib, has_key).alias("matched"))


@check("scan_stats", f"""WITH {FACTS} SELECT 'discovery_method' AS dimension, discovery_method AS value, count(*) AS n FROM facts GROUP BY 2
UNION ALL SELECT 'artifact_category', artifact_category, count(*) FROM facts GROUP BY 2""")
def _(spark, sf):
    return reports.scan_stats(finding_facts(spark, sf))


@check("methods_per_target", f"""WITH {FACTS} SELECT regexp_extract(file_path, '^[^/]*') AS target, count(*) AS findings, string_agg(DISTINCT discovery_method, ', ' ORDER BY discovery_method) AS methods FROM facts GROUP BY 1
UNION ALL SELECT NULL, count(*), string_agg(DISTINCT discovery_method, ', ' ORDER BY discovery_method) FROM facts""")
def _(spark, sf):
    facts = finding_facts(spark, sf).withColumn("root", F.substring_index("file_path", "/", 1))
    return reports.methods_per_target(facts, "root")


@check("filter_findings", f"""WITH {FACTS} SELECT finding_id FROM facts WHERE suspected_algorithm = 'RSA' AND artifact_category = 'ASYMMETRIC_PKC'
  AND lower(scanner_name) LIKE '%python%' AND discovery_method = 'AST' AND round(confidence_score, 4) >= 0.6""")
def _(spark, sf):
    return listing.filter_findings(findings(spark, sf), "RSA", "ASYMMETRIC_PKC", "PYTHON", "AST", 0.6).select("finding_id")


@check("search_findings", f"""WITH {FACTS} SELECT finding_id FROM facts WHERE contains(lower(coalesce(suspected_algorithm,'') || ' ' || coalesce(library_hint,'')), '56 hashlib') OR contains(lower(file_path), '56 hashlib')""")
def _(spark, sf):
    return listing.search(findings(spark, sf), "56 HASHLIB", ["suspected_algorithm", "library_hint"], "location.file_path").select("finding_id")


@check("finding_view", f"""WITH {FACTS} SELECT finding_id, discovery_method, suspected_algorithm, key_size_hint, curve_hint, file_path, start_line, round(confidence_score, 4) AS confidence_score,
  CASE WHEN confidence_score >= 0.85 THEN 'VERY_HIGH' WHEN confidence_score >= 0.70 THEN 'HIGH' WHEN confidence_score >= 0.45 THEN 'MEDIUM' WHEN confidence_score >= 0.20 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence_level FROM facts""")
def _(spark, sf):
    return listing.finding_view(findings(spark, sf)).select(
        "finding_id", "discovery_method", "suspected_algorithm", "key_size_hint", "curve_hint", "location.file_path",
        "location.start_line", "confidence_score", "confidence_level")


@check("legacy_finding_view", f"""WITH {FACTS} SELECT finding_id, lower(discovery_method) AS scanner_type, file_path AS source_file, start_line AS line_number,
  CASE WHEN confidence_score >= 0.85 THEN 'VERY_HIGH' WHEN confidence_score >= 0.70 THEN 'HIGH' WHEN confidence_score >= 0.45 THEN 'MEDIUM' WHEN confidence_score >= 0.20 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence FROM facts""")
def _(spark, sf):
    return listing.legacy_finding_view(findings(spark, sf)).select(
        "finding_id", "scanner_type", "source_file", "line_number", "confidence")


@check("finding_problems", f"""WITH {FACTS} SELECT finding_id, 'error' AS severity, 'confidence_range' AS rule FROM facts WHERE confidence_score * 1.3 > 1
UNION ALL SELECT finding_id, 'error', 'category_missing' FROM facts WHERE library_hint IS NULL""")
def _(spark, sf):
    hurt = findings(spark, sf).withColumn("confidence_score", F.col("confidence_score") * 1.3).withColumn(
        "artifact_category", F.when(F.col("library_hint").isNotNull(), F.col("artifact_category")))
    return quality.finding_problems(hurt)


@check("page_findings", f"WITH {FACTS} SELECT finding_id, confidence_score FROM facts ORDER BY confidence_score DESC NULLS FIRST, finding_id LIMIT 50")
def _(spark, sf):
    key, order = listing.DEFAULT_SORT["findings"]
    return listing.paginate(findings(spark, sf), key, order, ["finding_id"]).select("finding_id", "confidence_score")
