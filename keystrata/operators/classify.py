"""Classical and quantum security of assets: a rule id per asset, then a decision table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.dims import aliases, policy, small
from keystrata.functions.binding import bind
from keystrata.functions.naming import contains_any, starts_with_any
from keystrata.functions.text import lookup

CLASSIFIED = [
    "classical_security_status", "quantum_vulnerable", "quantum_threat_type", "quantum_security_status",
    "effective_classical_security_bits", "effective_quantum_security_bits", "classification_confidence",
]


def with_upper(assets: DataFrame) -> DataFrame:
    """Adds the upper-cased name and family the rules test. The rules are evaluated in
    several bound steps: one large expression would compile to a method the JVM refuses
    to optimise."""
    return bind(
        assets,
        _ua=F.upper(F.coalesce("algorithm", F.lit(""))),
        _uf=F.upper(F.coalesce("algorithm_family", F.lit(""))),
    )


def _alg() -> Column:
    return F.col("_ua")


def _family() -> Column:
    return F.col("_uf")


def _has(*parts: str) -> Column:
    return contains_any(_alg(), list(parts))


def _cipher_rule() -> Column:
    key = F.col("key_length_bits")
    first_part = F.regexp_extract(_alg(), "^[^-_/]*", 0)
    broken = _family().isin("DES", "RC4") | first_part.isin("DES", "RC4")
    half = F.floor(key / 2)
    return (
        F.when(broken, "cipher:broken")
        .when((_family() == "3DES") | _has("3DES", "TRIPLE"), "cipher:3des")
        .when(_has("CHACHA"), "cipher:chacha")
        .when(~(_has("AES") | (_family() == "AES")), "cipher:?")
        .when(key.isNull(), "aes:?")
        .when(half >= policy.QUANTUM_THRESHOLD_BITS, "aes:safe")
        .otherwise("aes:degraded")
    )


def _mac_rule() -> Column:
    squeezed = F.regexp_replace(_alg(), "[-_]", "")
    by_hash = F.lit("mac:hmac")
    for name in reversed(policy.MAC_HASH_ORDER):
        by_hash = F.when(F.contains(squeezed, F.lit(name.replace("-", ""))), f"mac:{name}").otherwise(by_hash)
    return (
        F.when(_has("POLY1305"), "mac:poly1305")
        .when(_has("HMAC"), by_hash)
        .when(_has("CMAC", "OMAC"), "mac:cmac")
        .otherwise("mac:?")
    )


def _kdf_rule() -> Column:
    return (
        F.when(_has("ARGON2"), "kdf:argon2").when(_has("HKDF", "BCRYPT", "SCRYPT", "PBKDF2"), "kdf:hash").otherwise("kdf:?")
    )


def _uses_modulus() -> Column:
    fam = _family()
    return (
        (fam == "RSA") | _has("RSA")
        | (fam == "DSA") | (_has("DSA") & ~_has("ECDSA"))
        | (fam == "DH") | (_has("DH") & ~_has("ECDH"))
    )


def _uses_curve() -> Column:
    return _family().isin("ECC", "ECDSA", "ECDH", "ED25519") | _has("ECDSA", "ECDH", "ED25519", "EC ")


def _modulus_bits(key: Column) -> Column:
    bits = F.lit(policy.SMALLEST_MODULUS_BITS)
    for floor, value in reversed(policy.MODULUS_BITS):
        bits = F.when(key >= floor, value).otherwise(bits)
    return F.when(key.isNotNull(), bits)


def _public_key_rule() -> Column:
    key, curve = F.col("key_length_bits"), F.col("curve")
    by_key = (
        F.when(key.isNull(), "public:UNKNOWN:open")
        .when(key >= 2048, "public:SECURE:known")
        .when(key >= 1024, "public:WEAK:known")
        .when(key == 0, "public:BROKEN:open")
        .otherwise("public:BROKEN:known")
    )
    by_curve = (
        F.when(F.coalesce(curve, F.lit("")) == "", "public:UNKNOWN:open")
        .when(curve.isin(list(policy.CURVE_BITS)), "public:SECURE:known")
        .otherwise("public:UNKNOWN:known")
    )
    return F.when(F.col("_modulus"), by_key).when(F.col("_curved"), by_curve).otherwise("public:UNKNOWN:open")


def with_rule(assets: DataFrame) -> DataFrame:
    """Adds ``_rule``, the first rule that applies to an asset, in the order below."""
    prim = F.col("primitive_type")
    hashes = [h[0] for h in policy.HASH_PROFILES]
    public = prim.isin("ASYMMETRIC_ENCRYPTION", "DIGITAL_SIGNATURE", "KEY_EXCHANGE")
    df = with_upper(assets)
    df = bind(
        df,
        _pqc=starts_with_any(_alg(), aliases.PQC_PREFIXES) | _family().isin(aliases.PQC_PREFIXES),
        _modulus=public & _uses_modulus(),
        _curved=public & _uses_curve(),
    )
    df = bind(
        df,
        _keyed=F.when(prim == "MAC", _mac_rule()).when(prim == "KDF", _kdf_rule()),
    )
    df = bind(
        df,
        _by_kind=F.when(prim == "SYMMETRIC_CIPHER", _cipher_rule()).when(public, _public_key_rule()),
    )
    rule = (
        F.when(prim.isin(policy.NOT_CLASSIFIED_PRIMITIVES), "none")
        .when(_alg().isin("", "UNKNOWN ALGORITHM", "UNKNOWN"), "unknown")
        .when(F.col("_pqc"), "pqc")
        .when(prim == "PROTOCOL", "protocol")
        .when((prim == "HASH_FUNCTION") & F.col("algorithm").isin(hashes), F.concat(F.lit("hash:"), F.col("algorithm")))
        .when(prim == "HASH_FUNCTION", "hash:?")
        .otherwise(F.coalesce("_keyed", "_by_kind", F.lit("unknown")))
    )
    return bind(df, _rule=rule)


def classify(assets: DataFrame, notes: bool = True) -> DataFrame:
    """Adds the classification columns (and, with ``notes``, their explanation).

    3DES is matched by exact family or name part, not by containing "DES", and is WEAK.
    Bits that no known key or curve backs stay null; a Shor-vulnerable asset has no
    quantum bits at all.
    """
    dim = small(assets.sparkSession, policy.classification_rows())
    df = with_rule(assets)
    df = df.join(dim, df["_rule"] == dim["rule"], "left")
    key = F.col("key_length_bits")
    aes = F.startswith(F.col("_rule"), F.lit("aes:"))
    public = F.startswith(F.col("_rule"), F.lit("public:"))
    out = df.select(
        *assets.columns,
        F.col("classical").alias("classical_security_status"),
        F.col("vulnerable").alias("quantum_vulnerable"),
        F.col("threat").alias("quantum_threat_type"),
        F.col("quantum").alias("quantum_security_status"),
        F.when(aes, key)
        .when(public & F.col("_modulus"), _modulus_bits(key))
        .when(public & F.col("_curved"), lookup(F.col("curve"), policy.CURVE_BITS))
        .otherwise(F.col("classical_bits"))
        .cast("int")
        .alias("effective_classical_security_bits"),
        F.when(aes, F.floor(key / 2)).otherwise(F.col("quantum_bits")).cast("int").alias(
            "effective_quantum_security_bits"
        ),
        F.col("confidence").alias("classification_confidence"),
        *([F.concat(
            F.lit("["), F.col("confidence"), F.lit("] Classical ["), F.col("classical"), F.lit("]: "),
            F.col("classical_text"), F.lit(" | Quantum ["), F.col("quantum"), F.lit("]: "), F.col("quantum_text"),
        ).alias("classification_notes")] if notes else []),
    )
    return out
