"""Canonical attributes of findings: one chain of projections and a broadcast lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.dims import aliases
from keystrata.functions import naming
from keystrata.functions.binding import bind
from keystrata.functions.text import lookup, nonempty, norm_path, strip
from keystrata.operators.lookups import resolve_algorithm

ATTRIBUTES = [
    "algorithm", "algorithm_family", "primitive_type", "key_length_bits",
    "curve", "mode", "padding", "implementation_library",
]


def _missing(key: Column) -> Column:
    return key.isNull() | (key == 0)


def normalize(findings: DataFrame, forms_in_libraries: bool = False) -> DataFrame:
    """Adds path_key and the eight canonical attribute columns to every finding.

    An explicit hint wins over a parameter parsed from a transformation string, that over
    an envelope symbol, that over the structured name, that over the raw symbol. Nothing
    is guessed: a parameter no source names stays null. The transformation form is not
    looked for in library findings, whose symbols hold plain paths, unless
    ``forms_in_libraries`` asks for it.
    """
    raw, said = F.col("_raw"), F.col("_said")
    hint = F.col("key_size_hint")
    df = bind(
        findings,
        _raw=strip(F.coalesce("raw_symbol", F.lit(""))),
        _said=nonempty(F.col("suspected_algorithm")),
        path_key=norm_path(F.coalesce("location.file_path", F.lit(""))),
        implementation_library=naming.canonical_library(F.col("library_hint")),
    )
    # Each form is read from the symbol, else from the suspected name: first the text that
    # has it, then its parts, then the attributes.
    allowed = F.lit(forms_in_libraries) | (F.col("artifact_category") != "LIBRARY")
    df = bind(df, _text=F.when(allowed, F.when(naming.has_transformation(raw), raw).when(naming.has_transformation(said), said)))
    df = bind(df, _parts=F.when(F.col("_text").isNotNull(), naming.transformation_parts(F.col("_text"))))
    df = bind(df, _form=F.when(F.col("_parts").isNotNull(), naming.transformation(F.col("_parts"))))
    df = bind(df, _said=F.coalesce("_form.algorithm", "_said"))
    df = bind(df, _text=F.when(naming.has_evp(raw), raw).when(naming.has_evp(said), said))
    df = bind(df, _parts=F.when(F.col("_text").isNotNull(), naming.evp_parts(F.col("_text"))))
    df = bind(df, _evp=F.when(F.col("_parts").isNotNull(), naming.evp(F.col("_parts"))))
    vague = said.isNull() | F.startswith(F.upper(said), F.lit("EVP")) | F.upper(said).isin("AES", "SHA", "RSA", "HASH")
    df = bind(df, _said=F.when(F.col("_evp.algorithm").isNotNull() & vague, F.col("_evp.algorithm")).otherwise(said))
    df = bind(df, _parts=naming.name_parts(said))
    df = bind(df, _name=F.when(said.isNotNull(), naming.structured_name(said, F.col("_parts"))))
    df = bind(
        df,
        _said=F.coalesce("_name.algorithm", "_said"),
        mode=F.coalesce(nonempty(F.col("mode_hint")), F.col("_form.mode"), F.col("_evp.mode"), F.col("_name.mode")),
        padding=F.col("_form.padding"),
        _key=F.when(_missing(hint), F.coalesce("_evp.key", "_name.key", hint)).otherwise(hint),
    )
    df = bind(df, _curve=naming.canonical_curve(F.col("curve_hint"), raw))
    df = bind(df, mode=naming.canonical_mode(F.col("mode")), _as_curve=lookup(F.lower(said), aliases.CURVES))
    low = F.lower(said)
    df = bind(
        df,
        key_length_bits=F.when(
            _missing(F.col("_key")), F.coalesce(naming.key_from_symbol(raw, said), F.col("_key"))
        ).otherwise(F.col("_key")),
        curve=F.coalesce("_curve", "_as_curve"),
        _clean=F.when(
            F.col("_as_curve").isNotNull(),
            F.when(low.isin("x25519", "curve25519"), "ECDH")
            .when(low.isin("ed25519", "edwards25519"), "Ed25519")
            .otherwise("ECDSA"),
        ).otherwise(F.replace(said, F.lit("_"), F.lit("-"))),
    )
    resolved = resolve_algorithm(df, "_clean")
    resolved = bind(resolved, _unsaid=F.when(F.col("_clean").isNull(), _unsuspected_name()))
    resolved = bind(resolved, _named=F.coalesce("_unsaid", _canonical_name()))
    resolved = bind(resolved, algorithm=F.col("_named.algorithm"), algorithm_family=F.col("_named.family"))
    return resolved.select(
        *findings.columns, "path_key",
        "algorithm", "algorithm_family",
        naming.primitive_type(
            F.col("artifact_category"), F.col("algorithm_family"), F.col("algorithm"), F.col("_raw")
        ).alias("primitive_type"),
        "key_length_bits", "curve", "mode", "padding", "implementation_library",
    )


def _named(algorithm: Column | str, family: Column | str | None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(algorithm).cast("string").alias("algorithm"), as_col(family).cast("string").alias("family")
    )


def _aes_name() -> Column:
    key = F.col("key_length_bits")
    return F.concat_ws("-", F.lit("AES"), F.when(~_missing(key), key.cast("string")), F.col("mode"))


def _unsuspected_name() -> Column:
    """struct<algorithm, family> where no algorithm is suspected: by category, else by what
    the symbol contains."""
    key, mode = F.col("key_length_bits"), F.col("mode")
    raw = F.upper("_raw")
    has = lambda *parts: naming.contains_any(raw, list(parts))
    cat = F.col("artifact_category")
    return (
        F.when(cat == "CERTIFICATE", _named("X.509 Certificate", "CERTIFICATE"))
        .when(cat == "KEY_MATERIAL", _named("Cryptographic Key Material", "KEY_MATERIAL"))
        .when(cat == "LIBRARY", _named(
            F.concat(F.lit("Library: "), F.coalesce("implementation_library", F.lit("Cryptographic Library"))),
            "LIBRARY"))
        .when(cat == "RANDOM", _named("CSPRNG", "RANDOM"))
        .when((cat == "PROTOCOL") & has("TLS"), _named("TLS", "PROTOCOL"))
        .when((cat == "PROTOCOL") & has("SSH"), _named("SSH", "PROTOCOL"))
        .when((cat == "PROTOCOL") & has("SSL"), _named("SSL", "PROTOCOL"))
        .when(has("RSA"), _named("RSA", "RSA"))
        .when(has("AES") & ~_missing(key) & mode.isNotNull(), _named(_aes_name(), "AES"))
        .when(has("AES"), _named("AES", "AES"))
        .when(has("SHA256", "SHA-256"), _named("SHA-256", "SHA"))
        .when(has("HMAC"), _named("HMAC", "MAC"))
        .when(has("PBKDF2"), _named("PBKDF2", "KDF"))
        .when(has("BCRYPT"), _named("bcrypt", "KDF"))
        .when(has("SECP256R1", "PRIME256V1"), _named("ECDSA", "ECC"))
        .otherwise(_named("Unknown Algorithm", None))
    )


def _canonical_name() -> Column:
    """struct<algorithm, family> of a suspected algorithm: its registry row, else its
    cleaned name with the part before the first dash as family."""
    clean, upper = F.col("_clean"), F.upper("_clean")
    out = F.when(F.col("algorithm_key") == "AES", _named(_aes_name(), "AES")).when(
        F.col("algorithm_key").isNotNull(), _named(F.col("canonical_name"), F.col("family"))
    )
    for prefix in aliases.PQC_PREFIXES:
        out = out.when(F.startswith(upper, F.lit(prefix)), _named(prefix, prefix))
    return (
        out.when(upper.rlike("^(SHA-|SHA3)"), _named(clean, "SHA"))
        .when(F.startswith(upper, F.lit("TLS")), _named("TLS", "PROTOCOL"))
        .when(F.startswith(upper, F.lit("SSL")), _named("SSL", "PROTOCOL"))
        .otherwise(_named(clean, F.substring_index(upper, "-", 1)))
    )
