"""Parsing of algorithm names, transformations and library symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.dims import aliases
from keystrata.functions.text import lookup, nonempty, pattern



def extract(text: Column, regex: str, group: int = 1) -> Column:
    """A regex group, null instead of empty when it did not match."""
    found = F.regexp_extract(text, regex, group)
    return F.when(found != "", found)


def canonical_mode(mode: Column) -> Column:
    """Upper case, library constant prefix MODE_ removed, known modes mapped."""
    bare = F.regexp_replace(F.upper(nonempty(mode)), "^MODE_", "")
    return F.coalesce(lookup(F.lower(bare), aliases.MODES), bare)


def canonical_padding(padding: Column) -> Column:
    return F.coalesce(lookup(F.lower(padding), aliases.PADDINGS), padding)


def canonical_curve(hint: Column, symbol: Column) -> Column:
    """A given curve by alias; without one, of the aliases found as words in the symbol the
    one that comes first in the alias list."""
    given = nonempty(hint)
    word = pattern(r"\b(?:" + "|".join(aliases.CURVES) + r")\b")
    found = F.lit(None).cast("string")
    for alias, curve in reversed(aliases.CURVES.items()):
        found = F.when(symbol.rlike(pattern(rf"\b{alias}\b")), curve).otherwise(found)
    return F.when(given.isNotNull(), F.coalesce(lookup(F.lower(given), aliases.CURVES), given)).otherwise(
        F.when(symbol.rlike(word), found)
    )


def canonical_library(hint: Column) -> Column:
    """Exact alias, else the longest alias contained, else the hint itself."""
    clean = nonempty(hint)
    low = F.lower(clean)
    contained = F.when(low == "crypto", F.lit("Node.js crypto")).otherwise(clean)
    for alias in reversed(sorted(aliases.LIBRARIES, key=len, reverse=True)):
        contained = F.when(F.contains(low, F.lit(alias)), aliases.LIBRARIES[alias]).otherwise(contained)
    return F.coalesce(lookup(low, aliases.LIBRARIES), contained)


_THREE = r"([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)"
_TWO = r"([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)"


def _groups(text: Column, regex: str, groups: str) -> Column:
    """The groups of a match in one pass, as an array; ``groups`` lists them split by |."""
    return F.split(F.regexp_replace(text, f"(?s)^.*?{regex}.*$", groups), r"\|")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def has_transformation(text: Column) -> Column:
    return F.contains(text, F.lit("/")) & text.rlike(_TWO)


def transformation_parts(text: Column) -> Column:
    """[algorithm, mode, padding] of a text that has a transformation."""
    return F.when(text.rlike(_THREE), _groups(text, _THREE, "$1|$2|$3")).otherwise(_groups(text, _TWO, "$1|$2|"))


def transformation(parts: Column) -> Column:
    return F.struct(
        parts[0].alias("algorithm"),
        canonical_mode(parts[1]).alias("mode"),
        canonical_padding(_filled(parts[2])).alias("padding"),
    )


def parse_transformation(text: Column) -> Column:
    """ALG/MODE/PADDING or ALG/MODE anywhere in the text, as struct<algorithm, mode, padding>
    (null without one)."""
    return F.when(has_transformation(text), transformation(transformation_parts(text)))


_EVP = r"(?i:EVP_)(?i:aes_(\d{3})_([a-z0-9]+)|(sha\d+|sha3_\d+|md5))"


def has_evp(text: Column) -> Column:
    """Whether the text holds an OpenSSL envelope name that tells an algorithm."""
    return F.contains(text, F.lit("EVP_")) & (text.rlike(_EVP) | F.upper(text).rlike("RSA|EC"))


def evp_parts(text: Column) -> Column:
    """[AES bits, AES mode, digest, plain algorithm] of such a text."""
    plain = F.when(F.contains(F.upper(text), F.lit("RSA")), "|||RSA").otherwise("|||ECDSA")
    return F.when(text.rlike(_EVP), _groups(text, _EVP, "$1|$2|$3|")).otherwise(F.split(plain, r"\|"))


def evp(parts: Column) -> Column:
    bits, mode = _filled(parts[0]), _filled(F.upper(parts[1]))
    digest = F.regexp_replace(F.upper(parts[2]), "^SHA(?=.)", "SHA-")
    return F.struct(
        F.when(bits.isNotNull(), F.concat_ws("-", F.lit("AES"), bits, mode))
        .when(parts[2] != "", digest).otherwise(parts[3]).alias("algorithm"),
        bits.cast("int").alias("key"),
        mode.alias("mode"),
    )


def parse_evp(text: Column) -> Column:
    """OpenSSL envelope names as struct<algorithm, key, mode> (null when not one)."""
    return F.when(has_evp(text), evp(evp_parts(text)))


_STRUCTURED = (
    r"(?i)^(?:AES(?:-(128|192|256)(?:-([A-Z0-9]+))?|(128|192|256)([A-Z]{2,4})?|-([A-Z]{3,4}))"
    r"|RSA-(512|1024|2048|3072|4096|7680|15360)|SHA(\d{3}))$"
)


def name_parts(name: Column) -> Column:
    """[AES bits, AES mode, RSA bits, SHA digits] of a structured name, null for others."""
    dashed = F.replace(name, F.lit("_"), F.lit("-"))
    return F.when(
        dashed.rlike(_STRUCTURED), F.split(F.regexp_replace(dashed, _STRUCTURED, "$1$3|$2$4$5|$6|$7"), r"\|")
    )


def structured_name(name: Column, parts: Column) -> Column:
    rsa, sha = _filled(parts[2]), _filled(parts[3])
    return F.struct(
        F.when(parts.isNull(), name)
        .when(rsa.isNotNull(), F.lit("RSA"))
        .when(sha.isNotNull(), F.concat(F.lit("SHA-"), sha))
        .otherwise(F.lit("AES"))
        .alias("algorithm"),
        F.coalesce(rsa, _filled(parts[0])).cast("int").alias("key"),
        F.upper(_filled(parts[1])).alias("mode"),
    )


def parse_algorithm_name(name: Column) -> Column:
    """Parameters carried by a structured name, as struct<algorithm, key, mode>.

    AES-256-GCM, AES-256, AES256[GCM], AES-GCM, RSA-2048 and SHA256 are understood;
    any other name comes back unchanged without parameters.
    """
    return structured_name(name, name_parts(name))


def key_from_symbol(symbol: Column, algorithm: Column) -> Column:
    """A modulus size named in the symbol, for RSA, DSA and DH algorithms only."""
    modulus = F.upper(algorithm).rlike("RSA|DSA|DH")
    return F.when(modulus, extract(symbol, pattern(r"\b(512|1024|2048|3072|4096)\b", False), 1).cast("int"))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.startswith(text, F.lit(prefix))
    return hit


def contains_any(text: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def is_pqc(algorithm: Column) -> Column:
    return starts_with_any(F.upper(algorithm), aliases.PQC_PREFIXES)


def primitive_type(category: Column, family: Column, algorithm: Column, symbol: Column) -> Column:
    """What the finding does: its category decides first, then family and name."""
    alg, fam, sym = F.upper(algorithm), F.upper(F.coalesce(family, F.lit(""))), F.upper(F.coalesce(symbol, F.lit("")))
    in_family = lambda *names: fam.isin(*names)
    named = lambda *names: fam.isin(*names) | alg.isin(*names)
    return (
        F.when(category.isin("LIBRARY", "CERTIFICATE", "KEY_MATERIAL", "RANDOM"), category)
        .when((category == "PROTOCOL") | in_family("PROTOCOL") | alg.isin("TLS", "SSL", "SSH"), "PROTOCOL")
        .when(in_family("AES", "DES", "3DES", "RC4") | F.contains(fam, F.lit("CHACHA")), "SYMMETRIC_CIPHER")
        .when(in_family("SHA", "MD5") | F.contains(alg, F.lit("SHA-")), "HASH_FUNCTION")
        .when(F.contains(fam, F.lit("MAC")) | F.contains(fam, F.lit("POLY1305")), "MAC")
        .when(in_family("PBKDF2", "BCRYPT", "SCRYPT", "ARGON2", "HKDF"), "KDF")
        .when(named("ECDH", "DH", "X25519", "ML-KEM"), "KEY_EXCHANGE")
        .when(named("ECDSA", "ED25519", "DSA", "ML-DSA", "SLH-DSA"), "DIGITAL_SIGNATURE")
        .when(in_family("RSA") & sym.rlike("SIGN|PSS"), "DIGITAL_SIGNATURE")
        .when(in_family("RSA") | (category == "ASYMMETRIC_PKC"), "ASYMMETRIC_ENCRYPTION")
        .when(category.isin("SYMMETRIC_CIPHER", "HASH_FUNCTION", "DIGITAL_SIGNATURE", "KEY_EXCHANGE"), category)
        .otherwise("UNKNOWN")
    )
