"""Cryptographic libraries: package, import and shared-object names."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# name, ecosystem, base confidence, primary algorithms, packages, imports, shared objects
_LIBRARIES = [
    ("pycryptodome", "python", 0.75, ["RSA", "AES", "DES", "3DES", "ECDSA", "SHA-256", "HMAC"], ["pycryptodome", "pycryptodomex",
     "crypto", "pycrypto"], ["Crypto", "Cryptodome"], []),
    ("cryptography", "python", 0.75, ["RSA", "AES", "ECDSA", "ECDH", "SHA-256", "SHA-512", "HMAC", "HKDF"], ["cryptography"],
     ["cryptography"], []),
    ("hashlib", "python", 0.70, ["MD5", "SHA-1", "SHA-256", "SHA-384", "SHA-512", "SHA-3"], [], ["hashlib"], []),
    ("ssl", "python", 0.70, ["TLS", "AES", "RSA"], [], ["ssl"], []),
    ("hmac", "python", 0.70, ["HMAC"], [], ["hmac"], []),
    ("bcrypt", "python", 0.80, ["bcrypt"], ["bcrypt"], ["bcrypt"], []),
    ("argon2-cffi", "python", 0.80, ["Argon2"], ["argon2-cffi", "argon2"], ["argon2"], []),
    ("paramiko", "python", 0.70, ["RSA", "ECDSA", "AES"], ["paramiko"], ["paramiko"], []),
    ("node:crypto", "javascript", 0.72, ["AES", "RSA", "ECDSA", "SHA-256", "HMAC"], [], ["crypto", "node:crypto"], []),
    ("crypto-js", "javascript", 0.75, ["AES", "MD5", "SHA-256", "HMAC"], ["crypto-js"], ["crypto-js", "CryptoJS"], []),
    ("jsonwebtoken", "javascript", 0.72, ["RSA", "ECDSA", "HMAC"], ["jsonwebtoken"], ["jsonwebtoken", "jwt"], []),
    ("node-forge", "javascript", 0.75, ["RSA", "AES", "SHA-256", "HMAC"], ["node-forge"], ["node-forge", "forge"], []),
    ("bcryptjs", "javascript", 0.78, ["bcrypt"], ["bcryptjs", "bcrypt"], ["bcryptjs", "bcrypt"], []),
    ("jose", "javascript", 0.70, ["RSA", "ECDSA", "AES"], ["jose", "node-jose"], ["jose"], []),
    ("javax.crypto", "java", 0.72, ["AES", "DES", "3DES", "RSA", "HMAC"], [], ["javax.crypto"], []),
    ("java.security", "java", 0.72, ["RSA", "DSA", "ECDSA", "SHA-256"], [], ["java.security"], []),
    ("BouncyCastle", "java", 0.80, ["RSA", "AES", "ECDSA", "ECDH", "SHA-256"], ["bcprov-jdk15on", "bcprov-jdk18on", "bouncycastle",
     "org.bouncycastle"], ["org.bouncycastle"], ["bcprov-jdk15on.jar", "bcprov-jdk18on.jar"]),
    ("OpenSSL", "c", 0.85, ["RSA", "AES", "ECDSA", "ECDH", "SHA-256", "SHA-512", "DES", "3DES", "TLS"], ["openssl", "libssl-dev",
     "openssl-devel"], ["openssl/", "openssl/evp.h", "openssl/rsa.h", "openssl/aes.h", "openssl/sha.h", "openssl/ssl.h"], ["libssl.so",
     "libssl.so.1.1", "libssl.so.3", "libcrypto.so", "libcrypto.so.1.1", "libcrypto.so.3", "libssl-1_1-x64.dll",
     "libcrypto-1_1-x64.dll", "ssleay32.dll", "libeay32.dll"]),
    ("libsodium", "c", 0.85, ["ED25519", "ECDH", "ChaCha20", "AES"], ["libsodium", "libsodium-dev"], ["sodium.h", "sodium/"],
     ["libsodium.so", "libsodium.so.23", "libsodium.dll", "libsodium-23.dll"]),
    ("mbedTLS", "c", 0.83, ["RSA", "AES", "ECDSA", "ECDH", "SHA-256", "TLS"], ["mbedtls", "libmbedtls-dev"], ["mbedtls/",
     "mbedtls/aes.h", "mbedtls/rsa.h"], ["libmbedtls.so", "libmbedcrypto.so", "libmbedx509.so", "mbedTLS.dll"]),
]
# --- end of fixed values ----------------------------------------------------


def library_rows() -> list[dict]:
    rows = []
    for ordinal, (name, eco, conf, algs, packages, imports, objects) in enumerate(_LIBRARIES):
        rows.append({
            "library_ordinal": ordinal,
            "library": name,
            "ecosystem": eco,
            "base_confidence": conf,
            "primary_algorithms": algs,
            "package_aliases": packages,
            "import_aliases": imports,
            "shared_objects": objects,
        })
    return rows


def library_alias_rows(kind: str) -> list[dict]:
    """Lower-cased alias rows of one kind; a repeated alias keeps its first
    position in the list but belongs to the library that named it last."""
    by_alias: dict[str, dict] = {}
    for row in library_rows():
        for alias in row[kind]:
            by_alias[alias.lower()] = row
    return [
        {
            "alias": alias,
            "alias_ordinal": i,
            "library": row["library"],
            "ecosystem": row["ecosystem"],
            "base_confidence": row["base_confidence"],
            "primary_algorithms": row["primary_algorithms"],
        }
        for i, (alias, row) in enumerate(by_alias.items())
    ]
