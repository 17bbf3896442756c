"""Small alias maps used while canonicalising findings."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
CURVES = {
    "secp256r1": "secp256r1", "prime256v1": "secp256r1", "p-256": "secp256r1", "p256": "secp256r1",
    "secp384r1": "secp384r1", "p-384": "secp384r1", "p384": "secp384r1",
    "secp521r1": "secp521r1", "p-521": "secp521r1", "p521": "secp521r1",
    "secp256k1": "secp256k1",
    "curve25519": "Curve25519", "x25519": "Curve25519",
    "ed25519": "Ed25519", "edwards25519": "Ed25519",
    "brainpoolp256r1": "brainpoolP256r1", "brainpoolp384r1": "brainpoolP384r1",
    "brainpoolp512r1": "brainpoolP512r1",
}

MODES = {"gcm": "GCM", "cbc": "CBC", "ctr": "CTR", "ecb": "ECB", "cfb": "CFB", "ofb": "OFB", "ccm": "CCM", "xts": "XTS"}

PADDINGS = {
    "pkcs5padding": "PKCS7", "pkcs7padding": "PKCS7", "pkcs7": "PKCS7", "pkcs5": "PKCS7",
    "nopadding": "NoPadding", "pkcs1padding": "PKCS1v15",
    "pkcs1_oaep": "PKCS1_OAEP", "oaep": "PKCS1_OAEP", "pss": "PSS",
}

LIBRARIES = {
    "javax.crypto": "javax.crypto", "java.security": "java.security",
    "bouncycastle": "BouncyCastle", "bcprov": "BouncyCastle",
    "pycryptodome": "pycryptodome", "cryptodome": "pycryptodome", "cryptography": "cryptography",
    "crypto-js": "crypto-js", "node:crypto": "Node.js crypto", "node-forge": "node-forge",
    "openssl": "OpenSSL", "libcrypto": "OpenSSL", "libssl": "OpenSSL", "libssl3": "OpenSSL",
    "libsodium": "libsodium", "sodium": "libsodium", "mbedtls": "mbedTLS",
    "hashlib": "hashlib", "hmac": "hmac", "bcrypt": "bcrypt", "paramiko": "paramiko",
    "jsonwebtoken": "jsonwebtoken",
}

PQC_PREFIXES = ["ML-KEM", "ML-DSA", "SLH-DSA"]

DISCOVERY_METHODS = [
    "AST", "REGEX", "IMPORT_ANALYSIS", "API_CALL", "STRING_ANALYSIS",
    "SYMBOL_INSPECTION", "LIBRARY_DETECTION", "PACKAGE_INSPECTION", "MANIFEST_ANALYSIS",
]
# --- end of fixed values ----------------------------------------------------
