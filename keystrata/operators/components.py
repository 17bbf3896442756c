"""CycloneDX 1.6 component records from classified assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.binding import bind
from keystrata.functions.naming import contains_any, is_pqc
from keystrata.functions.text import lookup
from keystrata.operators.listing import component_threat
from keystrata.operators.reports import distributions

# --- fixed values -----------------------------------------------------------
SPEC_VERSION = "1.6"
FORMAT = "CycloneDX"
NAMESPACE = "http://cyclonedx.org/schema/bom/1.6"
FIXED_SERIAL = "urn:uuid:00000000-0000-5000-8000-000000000000"
COMPONENT_TYPE = "cryptographic-asset"
ASSET_TYPES = ["algorithm", "certificate", "protocol", "related-crypto-material"]
AUTHENTICATED_MODES = ["GCM", "CCM", "EAX", "SIV", "OCB"]
STREAM_FAMILIES = ["CHACHA", "RC4", "CHACHA20", "SALSA20"]
PRIMITIVES = [
    "ae", "block-cipher", "drbg", "ekep", "hash", "kdf", "key-agree", "kem", "mac", "pke",
    "post-quantum", "public-key-encryption", "signature", "stream-cipher", "unknown",
]
_PRIMITIVE_OF = {
    "ASYMMETRIC_ENCRYPTION": "public-key-encryption", "DIGITAL_SIGNATURE": "signature", "KEY_EXCHANGE": "key-agree",
    "HASH_FUNCTION": "hash", "MAC": "mac", "KDF": "kdf", "RANDOM": "drbg",
}
_ASSET_TYPE_OF = {
    "CERTIFICATE": "certificate", "PROTOCOL": "protocol", "KEY_MATERIAL": "related-crypto-material",
    "LIBRARY": "related-crypto-material",
}
ENVIRONMENT = "software-plain-text"
# --- end of fixed values ----------------------------------------------------


def asset_type() -> Column:
    return F.coalesce(lookup(F.col("primitive_type"), _ASSET_TYPE_OF), F.lit("algorithm"))


def component_primitive() -> Column:
    """The component vocabulary's word for what the asset does."""
    alg, family = F.upper("algorithm"), F.upper(F.coalesce("algorithm_family", F.lit("")))
    stream = family.isin(STREAM_FAMILIES) | contains_any(alg, ["CHACHA", "RC4"])
    sealed = F.coalesce(F.upper("mode").isin(AUTHENTICATED_MODES), F.lit(False))
    return (
        F.when(F.startswith(alg, F.lit("ML-KEM")), "kem")
        .when(is_pqc(F.col("algorithm")), "post-quantum")
        .when(
            F.col("primitive_type") == "SYMMETRIC_CIPHER",
            F.when(stream, "stream-cipher").when(sealed, "ae").otherwise("block-cipher"),
        )
        .otherwise(F.coalesce(lookup(F.col("primitive_type"), _PRIMITIVE_OF), F.lit("unknown")))
    )


def display_name() -> Column:
    """Algorithm plus its known parameters: key and mode for ciphers; key else curve for
    encryption and key exchange; curve (elliptic) or key for signatures."""
    prim, alg = F.col("primitive_type"), F.upper("algorithm")
    key, name = F.col("key_length_bits").cast("string"), F.col("algorithm")
    elliptic = F.upper(F.coalesce("algorithm_family", F.lit(""))).isin("ECC", "ECDSA", "ED25519") | contains_any(
        alg, ["ECDSA", "ED25519"]
    )
    dashed = lambda *parts: F.concat_ws("-", name, *parts)
    return (
        F.when(prim == "SYMMETRIC_CIPHER", dashed(key, F.upper("mode")))
        .when(prim.isin("ASYMMETRIC_ENCRYPTION", "KEY_EXCHANGE"), dashed(F.coalesce(key, F.col("curve"))))
        .when((prim == "DIGITAL_SIGNATURE") & elliptic, dashed(F.col("curve")))
        .when(prim == "DIGITAL_SIGNATURE", dashed(key))
        .otherwise(name)
    )


def parameter_set() -> Column:
    return F.coalesce(F.col("key_length_bits").cast("string"), F.col("curve"))


def quantum_level() -> Column:
    bits = F.col("effective_quantum_security_bits")
    return F.when(bits >= 256, 5).when(bits >= 192, 3).when(bits >= 128, 1)


def component_properties(prefix: str = "keystrata") -> Column:
    """Name/value pairs of what is known, sorted by name. The implementing library is
    among them."""
    cells = {
        "asset-id": F.col("asset_id"),
        "classical-security-status": F.col("classical_security_status"),
        "classification-notes": F.col("classification_notes"),
        "confidence": F.round("confidence_score", 4).cast("string"),
        "confidence-level": F.col("confidence_level"),
        "effective-classical-security-bits": F.col("effective_classical_security_bits").cast("string"),
        "effective-quantum-security-bits": F.col("effective_quantum_security_bits").cast("string"),
        "implementation-library": F.col("implementation_library"),
        "quantum-security-status": F.col("quantum_security_status"),
        "quantum-threat-type": F.col("quantum_threat_type"),
        "quantum-vulnerable": F.col("quantum_vulnerable").cast("string"),
    }
    return F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(f"{prefix}:{n}").alias("name"), v.alias("value")))
        for n, v in sorted(cells.items())
    ]))


def to_components(assets: DataFrame) -> DataFrame:
    """One component per classified asset. ``evidence`` holds the primary location; all
    locations and finding ids come from ``component_evidence`` as rows."""
    df = bind(assets, _type=asset_type())
    algorithm = F.when(
        F.col("_type") == "algorithm",
        F.struct(
            component_primitive().alias("primitive"),
            F.lit(ENVIRONMENT).alias("execution_environment"),
            parameter_set().alias("parameter_set_identifier"),
            F.col("curve").alias("curve"),
            F.lower("mode").alias("mode"),
            F.col("padding").alias("padding"),
            F.col("effective_classical_security_bits").alias("classical_security_level"),
            quantum_level().alias("nist_quantum_security_level"),
        ),
    )
    place = F.col("location")
    return df.select(
        F.lit(COMPONENT_TYPE).alias("type"),
        F.col("asset_id").alias("bom_ref"),
        display_name().alias("name"),
        F.struct(
            F.col("_type").alias("asset_type"),
            algorithm.alias("algorithm_properties"),
            F.col("implementation_library").alias("implementation_library"),
        ).alias("crypto_properties"),
        F.array_compact(F.array(F.when(place.isNotNull(), F.struct(
            F.when(place["file_path"] != "", place["file_path"]).alias("location"),
            place["start_line"].alias("line"),
            F.when(place["snippet"] != "", place["snippet"]).alias("symbol"),
        )))).alias("evidence"),
        component_properties().alias("properties"),
    )


def component_evidence(evidence: DataFrame) -> DataFrame:
    """Every occurrence behind every component, one row each: reference, finding, place."""
    place = F.col("location")
    return evidence.select(
        F.col("asset_id").alias("bom_ref"), "finding_id", "emit_seq",
        F.when(place["file_path"] != "", place["file_path"]).alias("location"),
        place["start_line"].alias("line"),
        F.when(place["snippet"] != "", place["snippet"]).alias("symbol"),
    )


def with_occurrences(components: DataFrame, evidence: DataFrame, size: int = 1000) -> DataFrame:
    """Components with all occurrences of their asset in ``evidence`` instead of the primary
    one, at most ``size`` in a row: an asset with more has further rows, told apart by
    ``part``. ``evidence`` is the evidence of assets; components without any keep theirs."""
    spot = lambda x: F.struct(
        F.when(x["location"]["file_path"] != "", x["location"]["file_path"]).alias("location"), x["location"]["start_line"].alias("line"),
        F.when(x["location"]["snippet"] != "", x["location"]["snippet"]).alias("symbol"))
    number = F.row_number().over(Window.partitionBy("asset_id").orderBy("path_key", "emit_seq", "finding_id"))
    parts = evidence.withColumn("part", F.floor((number - 1) / size)).groupBy("asset_id", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("path_key", "emit_seq", "finding_id", "location"))), spot).alias("_all"))
    out = components.join(parts.withColumnRenamed("asset_id", "bom_ref"), "bom_ref", "left")
    return out.select(*(c for c in components.columns if c != "evidence"), F.coalesce("_all", "evidence").alias("evidence"), F.coalesce("part", F.lit(0)).alias("part"))


def document_header(spark, tool_version: str = "1.0.0", timestamp=None, deterministic: bool = True) -> DataFrame:
    """The one header row of a component document: a fixed serial and no time when
    deterministic, else a random serial and the given or current UTC time."""
    when = F.lit(None).cast("string")
    if not deterministic:
        moment = F.current_timestamp() if timestamp is None else F.lit(timestamp).cast("timestamp")
        when = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    serial = F.lit(FIXED_SERIAL) if deterministic else F.concat(F.lit("urn:uuid:"), F.uuid())
    return spark.range(1).select(
        F.lit(FORMAT).alias("bom_format"), F.lit(SPEC_VERSION).alias("spec_version"), serial.alias("serial_number"),
        F.lit(1).alias("version"), when.alias("timestamp"), F.lit("application").alias("tool_type"),
        F.lit("keystrata").alias("tool_name"), F.lit(tool_version).alias("tool_version"),
    )


def component_rows(components: DataFrame) -> DataFrame:
    """Flat scalar form of components, for listing and checks."""
    a = "crypto_properties.algorithm_properties"
    return components.select(
        "type", "bom_ref", "name", F.col("crypto_properties.asset_type").alias("asset_type"),
        F.col(f"{a}.primitive").alias("primitive"),
        F.col(f"{a}.parameter_set_identifier").alias("parameter_set_identifier"),
        F.col(f"{a}.curve").alias("curve"), F.col(f"{a}.mode").alias("mode"), F.col(f"{a}.padding").alias("padding"),
        F.col(f"{a}.classical_security_level").alias("classical_security_level"),
        F.col(f"{a}.nist_quantum_security_level").alias("nist_quantum_security_level"),
    )


def component_summary(components: DataFrame) -> DataFrame:
    """(dimension, value, n): components per asset type and per threat, and in total."""
    flat = components.select(
        F.coalesce("crypto_properties.asset_type", F.lit("unknown")).alias("asset_type"),
        component_threat(F.col("properties")).alias("threat"),
        F.lit("components").alias("total"),
    )
    return distributions(flat, ["asset_type", "threat", "total"])
