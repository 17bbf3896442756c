"""Known cryptographic API calls per language and how to read their arguments."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# library, call, algorithm, category, confidence, argument rules
# An argument rule names the position or keyword of a role.
_PYTHON = [
    ("pycryptodome", "RSA.generate", "RSA", "ASYMMETRIC_PKC", 0.95, {"key": "0"}),
    ("pycryptodome", "RSA.import_key", "RSA", "ASYMMETRIC_PKC", 0.92, {}),
    ("pycryptodome", "RSA.construct", "RSA", "ASYMMETRIC_PKC", 0.90, {}),
    ("pycryptodome", "PKCS1_OAEP.new", "RSA", "ASYMMETRIC_PKC", 0.93, {}),
    ("pycryptodome", "AES.new", "AES", "SYMMETRIC_CIPHER", 0.95, {"mode": "1"}),
    ("pycryptodome", "DES.new", "DES", "SYMMETRIC_CIPHER", 0.95, {}),
    ("pycryptodome", "DES3.new", "3DES", "SYMMETRIC_CIPHER", 0.95, {}),
    ("pycryptodome", "SHA256.new", "SHA-256", "HASH_FUNCTION", 0.95, {}),
    ("pycryptodome", "SHA512.new", "SHA-512", "HASH_FUNCTION", 0.95, {}),
    ("pycryptodome", "SHA1.new", "SHA-1", "HASH_FUNCTION", 0.95, {}),
    ("pycryptodome", "MD5.new", "MD5", "HASH_FUNCTION", 0.95, {}),
    ("pycryptodome", "HMAC.new", "HMAC", "MAC", 0.93, {}),
    ("pycryptodome", "ECC.generate", "ECDSA", "ASYMMETRIC_PKC", 0.93, {"curve": "curve"}),
    ("pycryptodome", "DSA.generate", "DSA", "DIGITAL_SIGNATURE", 0.93, {"key": "0"}),
    ("cryptography", "rsa.generate_private_key", "RSA", "ASYMMETRIC_PKC", 0.96, {"key": "key_size"}),
    ("cryptography", "rsa.RSAPublicKey", "RSA", "ASYMMETRIC_PKC", 0.88, {}),
    ("cryptography", "ec.generate_private_key", "ECDSA", "ASYMMETRIC_PKC", 0.95, {"curve": "0"}),
    ("cryptography", "ec.ECDH", "ECDH", "KEY_EXCHANGE", 0.93, {}),
    ("cryptography", "dh.generate_parameters", "DH", "KEY_EXCHANGE", 0.95, {"key": "key_size"}),
    ("cryptography", "Cipher", "AES", "SYMMETRIC_CIPHER", 0.88, {}),
    ("cryptography", "algorithms.AES", "AES", "SYMMETRIC_CIPHER", 0.96, {"key": "0"}),
    ("cryptography", "algorithms.TripleDES", "3DES", "SYMMETRIC_CIPHER", 0.96, {}),
    ("cryptography", "modes.GCM", "AES", "SYMMETRIC_CIPHER", 0.88, {}),
    ("cryptography", "modes.CBC", "AES", "SYMMETRIC_CIPHER", 0.85, {}),
    ("cryptography", "hashes.SHA256", "SHA-256", "HASH_FUNCTION", 0.96, {}),
    ("cryptography", "hashes.SHA512", "SHA-512", "HASH_FUNCTION", 0.96, {}),
    ("cryptography", "hashes.SHA1", "SHA-1", "HASH_FUNCTION", 0.96, {}),
    ("cryptography", "hashes.MD5", "MD5", "HASH_FUNCTION", 0.96, {}),
    ("cryptography", "hashes.SHA384", "SHA-384", "HASH_FUNCTION", 0.96, {}),
    ("cryptography", "hmac.HMAC", "HMAC", "MAC", 0.95, {}),
    ("cryptography", "PBKDF2HMAC", "PBKDF2", "KDF", 0.95, {}),
    ("cryptography", "HKDF", "HKDF", "KDF", 0.95, {}),
    ("cryptography", "Scrypt", "scrypt", "KDF", 0.95, {}),
    ("cryptography", "x509.load_pem_x509_certificate", "RSA", "CERTIFICATE", 0.85, {}),
    ("hashlib", "hashlib.md5", "MD5", "HASH_FUNCTION", 0.93, {}),
    ("hashlib", "hashlib.sha1", "SHA-1", "HASH_FUNCTION", 0.93, {}),
    ("hashlib", "hashlib.sha256", "SHA-256", "HASH_FUNCTION", 0.93, {}),
    ("hashlib", "hashlib.sha384", "SHA-384", "HASH_FUNCTION", 0.93, {}),
    ("hashlib", "hashlib.sha512", "SHA-512", "HASH_FUNCTION", 0.93, {}),
    ("hashlib", "hashlib.sha3_256", "SHA-3", "HASH_FUNCTION", 0.93, {}),
    ("hashlib", "hashlib.new", "UNKNOWN", "HASH_FUNCTION", 0.75, {"algorithm": "0"}),
    ("hashlib", "hashlib.pbkdf2_hmac", "PBKDF2", "KDF", 0.93, {"algorithm": "0"}),
    ("hmac", "hmac.new", "HMAC", "MAC", 0.92, {"algorithm": "digestmod"}),
    ("hmac", "hmac.HMAC", "HMAC", "MAC", 0.92, {}),
    ("ssl", "ssl.SSLContext", "TLS", "PROTOCOL", 0.85, {}),
    ("ssl", "ssl.wrap_socket", "TLS", "PROTOCOL", 0.85, {}),
    ("bcrypt", "bcrypt.hashpw", "bcrypt", "KDF", 0.95, {}),
    ("bcrypt", "bcrypt.checkpw", "bcrypt", "KDF", 0.90, {}),
    ("bcrypt", "bcrypt.gensalt", "bcrypt", "KDF", 0.88, {}),
]

_JAVASCRIPT = [
    ("node:crypto", "crypto.createCipheriv", "AES", "SYMMETRIC_CIPHER", 0.90, {"algorithm": "0"}),
    ("node:crypto", "crypto.createDecipheriv", "AES", "SYMMETRIC_CIPHER", 0.90, {"algorithm": "0"}),
    ("node:crypto", "crypto.createHash", "SHA-256", "HASH_FUNCTION", 0.90, {"algorithm": "0"}),
    ("node:crypto", "crypto.createHmac", "HMAC", "MAC", 0.90, {"algorithm": "0"}),
    ("node:crypto", "crypto.generateKeyPair", "RSA", "ASYMMETRIC_PKC", 0.90, {"key": "modulusLength", "algorithm": "0"}),
    ("node:crypto", "crypto.createSign", "RSA", "DIGITAL_SIGNATURE", 0.88, {"algorithm": "0"}),
    ("node:crypto", "crypto.createVerify", "RSA", "DIGITAL_SIGNATURE", 0.85, {"algorithm": "0"}),
    ("node:crypto", "crypto.pbkdf2", "PBKDF2", "KDF", 0.92, {"algorithm": "4"}),
    ("node:crypto", "crypto.pbkdf2Sync", "PBKDF2", "KDF", 0.92, {}),
    ("node:crypto", "crypto.scrypt", "scrypt", "KDF", 0.92, {}),
    ("node:crypto", "crypto.scryptSync", "scrypt", "KDF", 0.92, {}),
    ("jsonwebtoken", "jwt.sign", "RSA", "DIGITAL_SIGNATURE", 0.85, {"algorithm": "algorithm"}),
    ("jsonwebtoken", "jwt.verify", "RSA", "DIGITAL_SIGNATURE", 0.82, {}),
    ("crypto-js", "CryptoJS.AES.encrypt", "AES", "SYMMETRIC_CIPHER", 0.92, {}),
    ("crypto-js", "CryptoJS.AES.decrypt", "AES", "SYMMETRIC_CIPHER", 0.92, {}),
    ("crypto-js", "CryptoJS.SHA256", "SHA-256", "HASH_FUNCTION", 0.92, {}),
    ("crypto-js", "CryptoJS.SHA512", "SHA-512", "HASH_FUNCTION", 0.92, {}),
    ("crypto-js", "CryptoJS.MD5", "MD5", "HASH_FUNCTION", 0.92, {}),
    ("crypto-js", "CryptoJS.HmacSHA256", "HMAC", "MAC", 0.92, {}),
]

_JAVA = [
    ("javax.crypto", "KeyGenerator.getInstance", "AES", "SYMMETRIC_CIPHER", 0.90, {"algorithm": "0"}),
    ("javax.crypto", "Cipher.getInstance", "AES", "SYMMETRIC_CIPHER", 0.90, {"algorithm": "0"}),
    ("javax.crypto", "SecretKeyFactory.getInstance", "PBKDF2", "KDF", 0.88, {"algorithm": "0"}),
    ("java.security", "KeyPairGenerator.getInstance", "RSA", "ASYMMETRIC_PKC", 0.90, {"algorithm": "0"}),
    ("java.security", "MessageDigest.getInstance", "SHA-256", "HASH_FUNCTION", 0.90, {"algorithm": "0"}),
    ("java.security", "Signature.getInstance", "RSA", "DIGITAL_SIGNATURE", 0.90, {"algorithm": "0"}),
    ("java.security", "Mac.getInstance", "HMAC", "MAC", 0.90, {"algorithm": "0"}),
]

_CPP = [
    ("OpenSSL", "EVP_EncryptInit_ex", "AES", "SYMMETRIC_CIPHER", 0.90, {}),
    ("OpenSSL", "EVP_DecryptInit_ex", "AES", "SYMMETRIC_CIPHER", 0.90, {}),
    ("OpenSSL", "EVP_DigestInit_ex", "SHA-256", "HASH_FUNCTION", 0.88, {}),
    ("OpenSSL", "EVP_MD_CTX_new", "SHA-256", "HASH_FUNCTION", 0.80, {}),
    ("OpenSSL", "RSA_generate_key_ex", "RSA", "ASYMMETRIC_PKC", 0.95, {"key": "1"}),
    ("OpenSSL", "RSA_public_encrypt", "RSA", "ASYMMETRIC_PKC", 0.93, {}),
    ("OpenSSL", "RSA_private_decrypt", "RSA", "ASYMMETRIC_PKC", 0.93, {}),
    ("OpenSSL", "AES_encrypt", "AES", "SYMMETRIC_CIPHER", 0.90, {}),
    ("OpenSSL", "AES_set_encrypt_key", "AES", "SYMMETRIC_CIPHER", 0.92, {"key": "1"}),
    ("OpenSSL", "SHA256", "SHA-256", "HASH_FUNCTION", 0.90, {}),
    ("OpenSSL", "SHA512", "SHA-512", "HASH_FUNCTION", 0.90, {}),
    ("OpenSSL", "SHA1", "SHA-1", "HASH_FUNCTION", 0.90, {}),
    ("OpenSSL", "MD5", "MD5", "HASH_FUNCTION", 0.90, {}),
    ("OpenSSL", "EC_KEY_generate_key", "ECDSA", "ASYMMETRIC_PKC", 0.93, {}),
    ("OpenSSL", "EC_KEY_new_by_curve_name", "ECDSA", "ASYMMETRIC_PKC", 0.90, {"curve": "0"}),
    ("OpenSSL", "ECDH_compute_key", "ECDH", "KEY_EXCHANGE", 0.93, {}),
    ("OpenSSL", "SSL_CTX_new", "TLS", "PROTOCOL", 0.88, {}),
    ("OpenSSL", "SSL_connect", "TLS", "PROTOCOL", 0.82, {}),
]
# --- end of fixed values ----------------------------------------------------

_BY_LANGUAGE = {"python": _PYTHON, "javascript": _JAVASCRIPT, "java": _JAVA, "cpp": _CPP}


def api_rows() -> list[dict]:
    rows = []
    for language, calls in _BY_LANGUAGE.items():
        for library, call, algorithm, category, conf, args in calls:
            rows.append({
                "api_ordinal": len(rows),
                "language": language,
                "library": library,
                "api_name": call,
                "short_name": call.split(".")[-1],
                "algorithm": algorithm,
                "category": category,
                "base_confidence": conf,
                "key_arg": args.get("key"),
                "mode_arg": args.get("mode"),
                "curve_arg": args.get("curve"),
                "algorithm_arg": args.get("algorithm"),
            })
    return rows


def api_key_rows() -> list[dict]:
    """Lookup keys: a full name belongs to its last entry, a short name that is
    nobody's full name belongs to the first entry that has it."""
    keys: dict[tuple[str, str], dict] = {}
    qualified: set[tuple[str, str]] = set()
    for row in api_rows():
        full = (row["language"], row["api_name"].lower())
        keys[full] = row
        qualified.add(full)
        keys.setdefault((row["language"], row["short_name"].lower()), row)
    return [
        row | {"lookup_key": key, "is_qualified": (language, key) in qualified}
        for (language, key), row in keys.items()
    ]
