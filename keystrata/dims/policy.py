"""Decision tables: outcomes of the classification, risk and replacement rules, and
the policy numbers of the timeline. Rule ids are this library's own."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Modulus size floor -> equivalent classical bits; anything smaller counts as 56.
MODULUS_BITS = [(15360, 256), (7680, 192), (4096, 140), (3072, 128), (2048, 112), (1024, 80), (512, 56)]
SMALLEST_MODULUS_BITS = 56
CURVE_BITS = {
    "secp256r1": 128, "secp384r1": 192, "secp521r1": 260, "secp256k1": 128, "Curve25519": 128,
    "Ed25519": 128, "brainpoolP256r1": 128, "brainpoolP384r1": 192, "brainpoolP512r1": 256,
}
QUANTUM_THRESHOLD_BITS = 128

# hash | classical status | classical bits | quantum bits | quantum vulnerable
HASH_PROFILES = [
    ("MD5", "BROKEN", 0, None, True),
    ("SHA-1", "BROKEN", 0, None, True),
    ("SHA-256", "SECURE", 128, 85, True),
    ("SHA-384", "SECURE", 192, 128, False),
    ("SHA-512", "SECURE", 256, 171, False),
    ("SHA-3", "SECURE", None, None, False),
]
# Order in which a hash is looked for in a MAC name.
MAC_HASH_ORDER = ["SHA-512", "SHA-384", "SHA-256", "SHA-1", "MD5", "SHA-3"]

NOT_CLASSIFIED_PRIMITIVES = ["LIBRARY", "CERTIFICATE", "KEY_MATERIAL", "RANDOM"]
NO_TIMELINE_PRIMITIVES = ["LIBRARY", "RANDOM"]

BROKEN_NAMES_FOR_RISK = ["MD5", "SHA-1", "SHA1", "DES", "RC4", "BLOWFISH"]
BROKEN_NAMES_FOR_REPLACEMENT = [
    "MD5", "SHA-1", "SHA1", "DES", "3DES", "TRIPLEDES", "RC4", "RC2", "MD4", "MD2", "RIPEMD-128",
]
OVERALL_MAX_WEIGHT, OVERALL_MEAN_WEIGHT = 0.7, 0.3

MIGRATION_YEARS = {
    "ASYMMETRIC_ENCRYPTION": 4.0, "DIGITAL_SIGNATURE": 4.0, "KEY_EXCHANGE": 4.0,
    "SYMMETRIC_CIPHER": 1.5, "HASH_FUNCTION": 1.0, "MAC": 1.0, "KDF": 1.0, "PROTOCOL": 3.0,
    "LIBRARY": 2.0, "CERTIFICATE": 4.0, "KEY_MATERIAL": 4.0, "RANDOM": 3.0, "UNKNOWN": 3.0,
}
MIGRATION_YEARS_OTHER = 3.0
QUANTUM_ARRIVAL_YEARS = {"OPTIMISTIC": 7.0, "BASELINE": 10.0, "CONSERVATIVE": 15.0}
EXPOSURE_MIN_LIFETIME, EXPOSURE_CRITICAL, EXPOSURE_HIGH, EXPOSURE_MEDIUM = 1.0, 5.0, 0.0, -3.0
IMMEDIATE_GAP_YEARS, PLANNED_BUFFER_YEARS = 2.0, 3.0
URGENCIES = ["IMMEDIATE", "URGENT", "PLANNED", "MONITOR", "UNKNOWN", "NOT_REQUIRED"]
EXPOSURES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE", "UNKNOWN"]

HIGH_SECURITY_MODULUS = 3072
HASH_UPGRADES = {
    "SHA-256": "SHA-384", "SHA-224": "SHA-256", "SHA-1": "SHA-256", "SHA1": "SHA-256",
    "MD5": "SHA-256", "MD4": "SHA-256", "RIPEMD-160": "SHA-256",
}
CIPHER_UPGRADES = {
    "AES-128": "AES-256", "AES-128-ECB": "AES-256-GCM", "AES-128-CBC": "AES-256-GCM",
    "AES-128-CTR": "AES-256-GCM", "AES-128-GCM": "AES-256-GCM", "AES-128-CCM": "AES-256-GCM",
}
KEY_EXCHANGE_FAMILIES = ["DH", "ECDH", "X25519", "X448", "CURVE25519"]
SIGNATURE_FAMILIES = ["ECDSA", "DSA", "ED25519", "ED448", "RSASSA", "RSA-PSS", "RSAPSS"]
ENCRYPTION_FAMILIES = ["RSA", "ELGAMAL"]
RECOMMENDATION_TYPES = [
    "DIRECT_PQC", "CLASSICAL_UPGRADE", "HYBRID", "ALREADY_PQC", "NO_MIGRATION_REQUIRED", "UNKNOWN",
]
# --- end of fixed values ----------------------------------------------------

_SHOR, _GROVER, _BROKEN, _SAFE = (
    "SHOR_POLYNOMIAL_BREAK", "GROVER_BIT_HALVING", "CLASSICALLY_BROKEN", "QUANTUM_RESISTANT",
)


def _outcome(rule, classical, threat, quantum, vulnerable, confidence, classical_bits=None, quantum_bits=None,
             classical_text="", quantum_text=""):
    return {
        "rule": rule, "classical": classical, "threat": threat, "quantum": quantum, "vulnerable": vulnerable,
        "confidence": confidence, "classical_bits": classical_bits, "quantum_bits": quantum_bits,
        "classical_text": classical_text, "quantum_text": quantum_text,
    }


def _hash_outcomes() -> list[dict]:
    rows = []
    for name, status, cbits, qbits, vulnerable in HASH_PROFILES:
        broken = status == "BROKEN"
        threat = _BROKEN if broken else _GROVER if vulnerable else _SAFE
        quantum = "CRITICAL" if broken else "DEGRADED" if vulnerable else "SAFE"
        ctext = "collisions are practical" if broken else "collision resistance holds"
        qtext = {
            "CRITICAL": "already broken without a quantum computer",
            "DEGRADED": "quantum collision search leaves less than 128 bits",
            "SAFE": "quantum collision search leaves enough margin",
        }[quantum]
        rows.append(_outcome(f"hash:{name}", status, threat, quantum, vulnerable, "HIGH",
                             None if broken else cbits, qbits, ctext, qtext))
        rows.append(_outcome(f"mac:{name}", status, threat, quantum, vulnerable, "HIGH", cbits, qbits,
                             f"follows its hash {name}: {ctext}", f"follows its hash {name}: {qtext}"))
    return rows


def classification_rows() -> list[dict]:
    """Outcome per classification rule; bits that depend on key or curve are computed."""
    unknown = ("UNKNOWN", "UNKNOWN", "UNKNOWN", None, "UNKNOWN")
    rows = [
        _outcome("none", "UNKNOWN", "NOT_APPLICABLE", "UNKNOWN", False, "HIGH", None, None,
                 "not an algorithm", "quantum classification does not apply"),
        _outcome("unknown", *unknown, None, None, "algorithm not identified", "algorithm not identified"),
        _outcome("pqc", "SECURE", _SAFE, "SAFE", False, "HIGH", None, None,
                 "standardised post-quantum algorithm", "designed against quantum attack"),
        _outcome("protocol", "UNKNOWN", "NOT_APPLICABLE", "UNKNOWN", None, "LOW", None, None,
                 "depends on the negotiated suite", "depends on the negotiated suite"),
        _outcome("hash:?", *unknown, None, None, "hash not in the table", "hash not in the table"),
        _outcome("cipher:broken", "BROKEN", _BROKEN, "CRITICAL", True, "HIGH", None, None,
                 "cipher is broken", "already broken without a quantum computer"),
        _outcome("cipher:3des", "WEAK", _GROVER, "DEGRADED", True, "HIGH", 112, 56,
                 "about 112 bits, deprecated", "key search is halved to about 56 bits"),
        _outcome("cipher:chacha", "SECURE", _GROVER, "SAFE", False, "HIGH", 256, 128,
                 "fixed 256-bit key", "key search is halved to 128 bits"),
        _outcome("aes:?", "SECURE", _GROVER, "UNKNOWN", None, "LOW", None, None,
                 "key length unknown", "key length unknown"),
        _outcome("aes:safe", "SECURE", _GROVER, "SAFE", False, "HIGH", None, None,
                 "approved key length", "half the key length still meets 128 bits"),
        _outcome("aes:degraded", "SECURE", _GROVER, "DEGRADED", True, "HIGH", None, None,
                 "approved key length", "half the key length is below 128 bits"),
        _outcome("cipher:?", *unknown, None, None, "cipher not in the table", "cipher not in the table"),
        _outcome("mac:poly1305", "SECURE", _GROVER, "SAFE", False, "HIGH", None, None,
                 "secure with one-time keys", "comparable to ChaCha20"),
        _outcome("mac:hmac", "UNKNOWN", _GROVER, "UNKNOWN", None, "LOW", None, None,
                 "hash not named", "depends on the hash"),
        _outcome("mac:cmac", "SECURE", _GROVER, "UNKNOWN", None, "LOW", None, None,
                 "built on AES", "depends on the AES key length"),
        _outcome("mac:?", *unknown, None, None, "MAC not in the table", "MAC not in the table"),
        _outcome("kdf:argon2", "SECURE", _SAFE, "SAFE", False, "HIGH", None, None,
                 "memory-hard", "memory hardness limits quantum search"),
        _outcome("kdf:hash", "SECURE", _GROVER, "UNKNOWN", None, "LOW", None, None,
                 "sound derivation function", "depends on hash, cost and output length"),
        _outcome("kdf:?", *unknown, None, None, "KDF not in the table", "KDF not in the table"),
    ]
    for status in ("SECURE", "WEAK", "BROKEN", "UNKNOWN"):
        for known, confidence in ((True, "HIGH"), (False, "LOW")):
            rows.append(_outcome(
                f"public:{status}:{'known' if known else 'open'}", status, _SHOR, "CRITICAL", True, confidence,
                None, None,
                "strength follows the key or curve" if known else "key or curve unknown",
                "period finding solves the underlying problem outright",
            ))
    return rows + _hash_outcomes()


def _factor(name, score, maximum, field, reason):
    return {"name": name, "score": float(score), "maximum": float(maximum), "reason": reason, "source_field": field}


# --- fixed values: scores and maxima per rule --------------------------------
RISK_RULES = {
    "none": [_factor("operational_context", 0, 0, "primitive_type", "{algorithm} is not itself attackable by quantum algorithms")],
    "broken": [
        _factor("classical_vulnerability", 100, 100, "classical_security_status", "{algorithm} is broken without a quantum computer"),
        _factor("quantum_vulnerability", 0, 0, "quantum_threat_type", "the classical break supersedes the quantum threat"),
    ],
    "pqc": [_factor("quantum_vulnerability", 0, 0, "quantum_threat_type", "{algorithm} is a standardised post-quantum algorithm")],
    "shor": [_factor("quantum_vulnerability", 90, 90, "quantum_threat_type", "{algorithm} keys can be recovered by period finding")],
    "3des": [
        _factor("quantum_vulnerability", 60, 60, "quantum_threat_type", "quantum search leaves less than 64 bits of key strength"),
        _factor("classical_vulnerability", 15, 15, "classical_security_status", "deprecated cipher with small blocks"),
    ],
    "cipher:256": [
        _factor("quantum_vulnerability", 20, 20, "quantum_security_status", "{algorithm} keeps at least 128 bits under quantum search"),
        _factor("parameter_key_length", -10, 0, "key_length_bits", "a 256-bit key keeps its margin"),
    ],
    "cipher:128": [
        _factor("quantum_vulnerability", 60, 60, "quantum_threat_type", "{algorithm} strength is halved below 128 bits"),
        _factor("parameter_key_length", 10, 10, "key_length_bits", "a 128-bit key falls to about 64 bits"),
    ],
    "cipher:192": [
        _factor("quantum_vulnerability", 60, 60, "quantum_threat_type", "{algorithm} strength is halved below 128 bits"),
        _factor("parameter_key_length", -5, 0, "key_length_bits", "a 192-bit key falls to about 96 bits"),
    ],
    "cipher:?": [
        _factor("quantum_vulnerability", 45, 60, "quantum_threat_type", "{algorithm} key length is not known"),
        _factor("parameter_uncertainty", 5, 10, "key_length_bits", "no key length was found; none is assumed"),
    ],
    "hash:long": [_factor("quantum_vulnerability", 15, 20, "quantum_security_status", "{algorithm} keeps 128 bits of quantum collision resistance")],
    "hash:256": [_factor("quantum_vulnerability", 40, 40, "quantum_security_status", "{algorithm} falls to about 85 bits of quantum collision resistance")],
    "hash:224": [
        _factor("quantum_vulnerability", 55, 60, "quantum_security_status", "{algorithm} falls below 80 bits of quantum collision resistance"),
        _factor("classical_vulnerability", 10, 10, "classical_security_status", "legacy digest length"),
    ],
    "keyed:broken": [_factor("classical_vulnerability", 100, 100, "classical_security_status", "{algorithm} rests on a broken hash")],
    "keyed": [_factor("quantum_vulnerability", 30, 40, "quantum_security_status", "{algorithm} is adequate for authentication and derivation")],
    "protocol:broken": [_factor("classical_vulnerability", 100, 100, "classical_security_status", "protocol {algorithm} is broken")],
    "protocol:weak": [
        _factor("classical_vulnerability", 40, 40, "classical_security_status", "protocol {algorithm} allows weak settings"),
        _factor("quantum_vulnerability", 30, 40, "quantum_threat_type", "its handshake has no post-quantum part"),
    ],
    "protocol": [_factor("quantum_vulnerability", 25, 30, "quantum_security_status", "exposure of {algorithm} depends on the negotiated suite")],
    "unknown": [_factor("uncertainty_baseline", 50, 50, "algorithm", "{algorithm} is not in any registry; audit by hand")],
}
MOD_SHORT_RSA, MOD_LONG_RSA, MOD_PKCS1, MOD_ECB = 10.0, -5.0, 5.0, 15.0
# --- end of fixed values ------------------------------------------------------


def risk_rows() -> list[dict]:
    return [
        {"rule": rule, "base_score": sum(f["score"] for f in factors), "base_factors": factors}
        for rule, factors in RISK_RULES.items()
    ]


_KEM_HYBRID, _SIG_HYBRID = "X25519 + ML-KEM-768", "Ed25519 + ML-DSA-65"
_F203, _F204, _F205 = "NIST FIPS 203", "NIST FIPS 204", "NIST FIPS 205"
_LIBS = "check that the libraries in use offer the algorithm"
_DRAFT = "hybrid constructions are still being standardised"

# --- fixed values: outcome per replacement rule -------------------------------
# rule -> (type, target, standard, hybrid, confidence, complexity)
RECOMMENDATION_OUTCOMES = {
    "pqc:203": ("ALREADY_PQC", None, _F203, None, "HIGH", "LOW"),
    "pqc:204": ("ALREADY_PQC", None, _F204, None, "HIGH", "LOW"),
    "pqc:205": ("ALREADY_PQC", None, _F205, None, "HIGH", "LOW"),
    "none": ("NO_MIGRATION_REQUIRED", None, None, None, "HIGH", "LOW"),
    "hash:broken": ("CLASSICAL_UPGRADE", "SHA-256", None, None, "HIGH", "MEDIUM"),
    "hash:upgrade": ("CLASSICAL_UPGRADE", None, None, None, "HIGH", "MEDIUM"),
    "hash:fine": ("NO_MIGRATION_REQUIRED", None, None, None, "HIGH", "LOW"),
    "cipher:broken": ("CLASSICAL_UPGRADE", "AES-256-GCM", None, None, "HIGH", "MEDIUM"),
    "cipher:fine": ("NO_MIGRATION_REQUIRED", None, None, None, "HIGH", "LOW"),
    "cipher:upgrade": ("CLASSICAL_UPGRADE", "AES-256-GCM", None, None, "HIGH", "LOW"),
    "cipher:?": ("UNKNOWN", None, None, None, "INSUFFICIENT_DATA", "LOW"),
    "keyed:broken": ("CLASSICAL_UPGRADE", "HMAC-SHA-256", None, None, "HIGH", "MEDIUM"),
    "certificate": ("HYBRID", None, _F204, _SIG_HYBRID, "HIGH", "HIGH"),
    "signature:hybrid": ("HYBRID", None, _F204, _SIG_HYBRID, "HIGH", "HIGH"),
    "signature:direct": ("DIRECT_PQC", None, _F204, None, "HIGH", "HIGH"),
    "exchange": ("HYBRID", None, _F203, _KEM_HYBRID, "HIGH", "HIGH"),
    "encryption": ("HYBRID", None, _F203, _KEM_HYBRID, "HIGH", "HIGH"),
    "unknown": ("UNKNOWN", None, None, None, "INSUFFICIENT_DATA", "MEDIUM"),
}
PARAMETER_SETS = {
    "kem:high": ("ML-KEM-1024", 5), "kem": ("ML-KEM-768", 3),
    "dsa:high": ("ML-DSA-87", 5), "dsa": ("ML-DSA-65", 3),
}
# --- end of fixed values ------------------------------------------------------

# rule group -> (rationale, limitations, guidance)
_ADVICE = {
    "pqc": (["{algorithm} already is a post-quantum standard"], [], ["keep parameters under review"]),
    "none": (["{algorithm} needs no replacement of its own"], [], ["keep it patched", "revisit with the next scan"]),
    "hash:broken": (["{algorithm} is broken", "move to {target} first of all"], ["the classical weakness comes first"],
                    ["find every use of the digest", "switch to {target}", "re-sign or re-hash stored values"]),
    "hash:upgrade": (["{algorithm} loses collision resistance to quantum search", "{target} restores the margin"], [],
                     ["find every use of the digest", "switch to {target}", "check stored digest lengths"]),
    "hash:fine": (["{algorithm} keeps enough collision resistance"], [], ["keep parameters under review"]),
    "cipher:broken": (["{algorithm} is broken", "move to {target} first of all"], ["the classical weakness comes first"],
                      ["re-encrypt stored data with {target}", "rotate the keys"]),
    "cipher:fine": (["{algorithm} keeps at least 128 bits under quantum search"], [], ["keep parameters under review"]),
    "cipher:upgrade": (["{algorithm} strength is halved by quantum search", "{target} restores the margin"], [],
                       ["generate longer keys", "switch to {target}", "re-encrypt stored data"]),
    "cipher:?": (["{algorithm} key length is not known"], ["the key length must be found first"], ["find the key length"]),
    "keyed:broken": (["{algorithm} rests on a broken hash", "move to {target}"], ["the classical weakness comes first"],
                     ["switch to {target}", "re-issue derived keys or tags"]),
    "certificate": (["{algorithm} signatures can be forged by a quantum computer", "{target} suits its level"],
                    [_LIBS, _DRAFT, "the issuing authority must support it"],
                    ["list all certificates", "plan hybrid issuance", "shorten validity until then"]),
    "signature:hybrid": (["{algorithm} signatures can be forged by a quantum computer", "{target} suits its level",
                          "a hybrid keeps old verifiers working"], [_LIBS, _DRAFT],
                         ["sign with both algorithms", "verify both", "retire the classical part"]),
    "signature:direct": (["{algorithm} signatures can be forged by a quantum computer", "{target} suits its level"],
                         [_LIBS], ["generate {target} keys", "switch signing, then verifying"]),
    "exchange": (["{algorithm} secrets can be recovered by a quantum computer", "{target} suits its level",
                  "a hybrid keeps the classical security meanwhile"], [_LIBS, _DRAFT],
                 ["enable the hybrid group", "prefer it in negotiation", "retire the classical group"]),
    "encryption": (["{algorithm} private keys can be recovered by a quantum computer", "{target} suits its level",
                    "a hybrid keeps the classical security meanwhile"], [_LIBS, _DRAFT],
                   ["wrap keys with the hybrid", "re-wrap stored keys", "retire the classical key"]),
    "unknown": (["{algorithm} could not be mapped"], ["needs an audit by hand"],
                ["audit the use by hand", "consult the standards for its family"]),
}


def recommendation_rows() -> list[dict]:
    rows = []
    for rule, (kind, target, standard, hybrid, confidence, complexity) in RECOMMENDATION_OUTCOMES.items():
        rationale, limitations, guidance = _ADVICE[rule] if rule in _ADVICE else _ADVICE[rule.split(":")[0]]
        rows.append({
            "rule": rule, "recommendation_type": kind, "fixed_target": target, "pqc_standard": standard,
            "hybrid_recommendation": hybrid, "confidence": confidence, "migration_complexity": complexity,
            "rationale": rationale, "limitations": limitations, "guidance": guidance,
        })
    return rows
