"""Algorithm vocabulary: canonical names, spellings, category, quantum threat."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# key, canonical name, category, quantum threat, minimum key bits, spellings
_ALGORITHMS = [
    ("RSA", "RSA", "ASYMMETRIC_PKC", "SHOR_POLYNOMIAL_BREAK", 2048, ["rsa", "rsa_oaep", "rsa-oaep", "rsa-pss", "rsassa", "pkcs1",
     "rsa_pkcs1", "rsa1_5"]),
    ("DSA", "DSA", "DIGITAL_SIGNATURE", "SHOR_POLYNOMIAL_BREAK", 2048, ["dsa"]),
    ("DH", "DH", "KEY_EXCHANGE", "SHOR_POLYNOMIAL_BREAK", 2048, ["dh", "diffie-hellman", "diffie_hellman", "dhparam", "dh_param"]),
    ("ECDH", "ECDH", "KEY_EXCHANGE", "SHOR_POLYNOMIAL_BREAK", 256, ["ecdh", "ecdhe", "x25519", "x448", "elliptic_curve_diffie_hellman"]),
    ("ECDSA", "ECDSA", "DIGITAL_SIGNATURE", "SHOR_POLYNOMIAL_BREAK", 256, ["ecdsa", "ec", "ecc", "elliptic_curve", "elliptic curve"]),
    ("ED25519", "Ed25519", "DIGITAL_SIGNATURE", "SHOR_POLYNOMIAL_BREAK", 0, ["ed25519", "edwards25519", "eddsa"]),
    ("AES", "AES", "SYMMETRIC_CIPHER", "GROVER_BIT_HALVING", 256, ["aes", "aes128", "aes-128", "aes_128", "aes192", "aes-192",
     "aes_192", "aes256", "aes-256", "aes_256", "rijndael", "aes-128-cbc", "aes-256-cbc", "aes-128-gcm", "aes-256-gcm", "aes-128-ctr",
     "aes-256-ctr", "aes-128-cfb", "aes-256-cfb", "aes-128-ecb", "aes-256-ecb"]),
    ("DES", "DES", "SYMMETRIC_CIPHER", "CLASSICALLY_BROKEN", 999, ["des"]),
    ("3DES", "3DES", "SYMMETRIC_CIPHER", "GROVER_BIT_HALVING", 999, ["3des", "triple-des", "triple_des", "tripledes", "des3", "des-ede",
     "des-ede3", "desede", "tdea"]),
    ("CHACHA20", "ChaCha20", "SYMMETRIC_CIPHER", "GROVER_BIT_HALVING", 256, ["chacha20", "chacha", "chacha20-poly1305", "xchacha20"]),
    ("RC4", "RC4", "SYMMETRIC_CIPHER", "CLASSICALLY_BROKEN", 0, ["rc4", "arcfour", "arc4"]),
    ("MD5", "MD5", "HASH_FUNCTION", "CLASSICALLY_BROKEN", 0, ["md5"]),
    ("SHA-1", "SHA-1", "HASH_FUNCTION", "CLASSICALLY_BROKEN", 0, ["sha1", "sha-1", "sha_1"]),
    ("SHA-256", "SHA-256", "HASH_FUNCTION", "GROVER_BIT_HALVING", 0, ["sha256", "sha-256", "sha_256", "sha2", "sha2-256"]),
    ("SHA-384", "SHA-384", "HASH_FUNCTION", "QUANTUM_RESISTANT", 0, ["sha384", "sha-384", "sha_384", "sha2-384"]),
    ("SHA-512", "SHA-512", "HASH_FUNCTION", "QUANTUM_RESISTANT", 0, ["sha512", "sha-512", "sha_512", "sha2-512"]),
    ("SHA-3", "SHA-3", "HASH_FUNCTION", "QUANTUM_RESISTANT", 0, ["sha3", "sha-3", "sha3-224", "sha3-256", "sha3-384", "sha3-512",
     "shake128", "shake256", "keccak"]),
    ("PBKDF2", "PBKDF2", "KDF", "GROVER_BIT_HALVING", 0, ["pbkdf2", "pbkdf2_hmac", "pbkdf2-hmac"]),
    ("BCRYPT", "bcrypt", "KDF", "GROVER_BIT_HALVING", 0, ["bcrypt"]),
    ("ARGON2", "Argon2", "KDF", "QUANTUM_RESISTANT", 0, ["argon2", "argon2id", "argon2i", "argon2d"]),
    ("HKDF", "HKDF", "KDF", "GROVER_BIT_HALVING", 0, ["hkdf"]),
    ("SCRYPT", "scrypt", "KDF", "GROVER_BIT_HALVING", 0, ["scrypt"]),
    ("HMAC", "HMAC", "MAC", "GROVER_BIT_HALVING", 0, ["hmac", "hmac-sha256", "hmac-sha1", "hmac-md5", "hmac_sha256", "hmacsha256",
     "hmacsha1"]),
    ("SSL", "SSL", "PROTOCOL", "CLASSICALLY_BROKEN", 0, ["sslv2", "sslv3", "ssl2", "ssl3", "ssl_v2", "ssl_v3", "sslv2_client",
     "ssl_protocol"]),
    ("TLS", "TLS", "PROTOCOL", "GROVER_BIT_HALVING", 0, ["tls", "tls1", "tls1.0", "tls1.1", "tls1.2", "tls1.3", "tls_v1", "tls_v1_1",
     "tls_v1_2", "tlsv1", "tlsv1_2", "tlsv1_client_method", "tlsv1_2_client_method"]),
    ("ML-KEM", "ML-KEM", "KEY_EXCHANGE", "QUANTUM_RESISTANT", 0, ["ml-kem", "mlkem", "kyber", "crystals-kyber", "ml_kem"]),
    ("ML-DSA", "ML-DSA", "DIGITAL_SIGNATURE", "QUANTUM_RESISTANT", 0, ["ml-dsa", "mldsa", "dilithium", "crystals-dilithium", "ml_dsa"]),
    ("SLH-DSA", "SLH-DSA", "DIGITAL_SIGNATURE", "QUANTUM_RESISTANT", 0, ["slh-dsa", "slhdsa", "sphincs", "sphincs+", "slh_dsa"]),
]

# Family reported for algorithms that share one; all others use their own key.
FAMILY_OVERRIDES = {
    "SHA-1": "SHA", "SHA-256": "SHA", "SHA-384": "SHA", "SHA-512": "SHA", "SHA-3": "SHA",
    "ECDSA": "ECC", "ECDH": "ECC", "ED25519": "ECC",
}
# --- end of fixed values ----------------------------------------------------


def algorithm_rows() -> list[dict]:
    rows = []
    for key, name, category, threat, bits, spellings in _ALGORITHMS:
        rows.append({
            "algorithm_key": key,
            "canonical_name": name,
            "family": FAMILY_OVERRIDES.get(key, key.upper()),
            "category": category,
            "quantum_threat": threat,
            "min_secure_key_bits": bits,
            "aliases": spellings,
        })
    return rows


def alias_rows() -> list[dict]:
    """One row per spelling (lower case); the key itself is a spelling too."""
    by_alias: dict[str, dict] = {}
    for row in algorithm_rows():
        for alias in [*row["aliases"], row["algorithm_key"]]:
            by_alias[alias.lower()] = row
    return [
        {k: row[k] for k in ("algorithm_key", "canonical_name", "family", "category", "quantum_threat")}
        | {"alias": alias}
        for alias, row in by_alias.items()
    ]
