"""Exported / imported binary symbols that identify cryptography."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# symbol, algorithm, category, confidence
_OPENSSL = [
    ("RSA_generate_key", "RSA", "ASYMMETRIC_PKC", 0.95),
    ("RSA_generate_key_ex", "RSA", "ASYMMETRIC_PKC", 0.95),
    ("RSA_public_encrypt", "RSA", "ASYMMETRIC_PKC", 0.95),
    ("RSA_private_decrypt", "RSA", "ASYMMETRIC_PKC", 0.95),
    ("RSA_public_decrypt", "RSA", "ASYMMETRIC_PKC", 0.93),
    ("RSA_private_encrypt", "RSA", "ASYMMETRIC_PKC", 0.93),
    ("RSA_new", "RSA", "ASYMMETRIC_PKC", 0.88),
    ("RSA_free", "RSA", "ASYMMETRIC_PKC", 0.82),
    ("RSA_sign", "RSA", "DIGITAL_SIGNATURE", 0.95),
    ("RSA_verify", "RSA", "DIGITAL_SIGNATURE", 0.95),
    ("RSA_padding_add_PKCS1_OAEP", "RSA", "ASYMMETRIC_PKC", 0.93),
    ("AES_encrypt", "AES", "SYMMETRIC_CIPHER", 0.93),
    ("AES_decrypt", "AES", "SYMMETRIC_CIPHER", 0.93),
    ("AES_set_encrypt_key", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("AES_set_decrypt_key", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("AES_cbc_encrypt", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("AES_cfb128_encrypt", "AES", "SYMMETRIC_CIPHER", 0.93),
    ("EVP_aes_128_gcm", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("EVP_aes_256_gcm", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("EVP_aes_128_cbc", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("EVP_aes_256_cbc", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("EVP_aes_256_ctr", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("EVP_EncryptInit_ex", "AES", "SYMMETRIC_CIPHER", 0.85),
    ("EVP_EncryptUpdate", "AES", "SYMMETRIC_CIPHER", 0.80),
    ("EVP_DecryptInit_ex", "AES", "SYMMETRIC_CIPHER", 0.85),
    ("EVP_DecryptUpdate", "AES", "SYMMETRIC_CIPHER", 0.80),
    ("EVP_DigestInit_ex", "SHA-256", "HASH_FUNCTION", 0.82),
    ("EVP_DigestUpdate", "SHA-256", "HASH_FUNCTION", 0.78),
    ("EVP_DigestFinal_ex", "SHA-256", "HASH_FUNCTION", 0.78),
    ("EVP_PKEY_keygen", "RSA", "ASYMMETRIC_PKC", 0.85),
    ("EVP_PKEY_CTX_new", "RSA", "ASYMMETRIC_PKC", 0.80),
    ("SHA256", "SHA-256", "HASH_FUNCTION", 0.93),
    ("SHA256_Init", "SHA-256", "HASH_FUNCTION", 0.93),
    ("SHA256_Update", "SHA-256", "HASH_FUNCTION", 0.90),
    ("SHA256_Final", "SHA-256", "HASH_FUNCTION", 0.90),
    ("SHA512", "SHA-512", "HASH_FUNCTION", 0.93),
    ("SHA512_Init", "SHA-512", "HASH_FUNCTION", 0.93),
    ("SHA1", "SHA-1", "HASH_FUNCTION", 0.93),
    ("SHA1_Init", "SHA-1", "HASH_FUNCTION", 0.93),
    ("MD5", "MD5", "HASH_FUNCTION", 0.93),
    ("MD5_Init", "MD5", "HASH_FUNCTION", 0.93),
    ("EC_KEY_generate_key", "ECDSA", "ASYMMETRIC_PKC", 0.95),
    ("EC_KEY_new_by_curve_name", "ECDSA", "ASYMMETRIC_PKC", 0.93),
    ("EC_KEY_new", "ECDSA", "ASYMMETRIC_PKC", 0.85),
    ("ECDSA_sign", "ECDSA", "DIGITAL_SIGNATURE", 0.95),
    ("ECDSA_verify", "ECDSA", "DIGITAL_SIGNATURE", 0.95),
    ("ECDH_compute_key", "ECDH", "KEY_EXCHANGE", 0.95),
    ("DSA_generate_key", "DSA", "DIGITAL_SIGNATURE", 0.95),
    ("DSA_sign", "DSA", "DIGITAL_SIGNATURE", 0.95),
    ("DSA_verify", "DSA", "DIGITAL_SIGNATURE", 0.95),
    ("DH_generate_key", "DH", "KEY_EXCHANGE", 0.95),
    ("DH_compute_key", "DH", "KEY_EXCHANGE", 0.95),
    ("DH_new", "DH", "KEY_EXCHANGE", 0.85),
    ("SSL_CTX_new", "TLS", "PROTOCOL", 0.90),
    ("SSL_new", "TLS", "PROTOCOL", 0.85),
    ("SSL_connect", "TLS", "PROTOCOL", 0.85),
    ("TLS_client_method", "TLS", "PROTOCOL", 0.90),
    ("TLS_server_method", "TLS", "PROTOCOL", 0.90),
    ("SSLv23_method", "SSL", "PROTOCOL", 0.88),
    ("SSLv3_method", "SSL", "PROTOCOL", 0.92),
]

_LIBSODIUM = [
    ("crypto_box", "ECDH", "KEY_EXCHANGE", 0.93),
    ("crypto_box_keypair", "ECDH", "KEY_EXCHANGE", 0.95),
    ("crypto_sign", "ED25519", "DIGITAL_SIGNATURE", 0.93),
    ("crypto_sign_keypair", "ED25519", "DIGITAL_SIGNATURE", 0.95),
    ("crypto_sign_ed25519_keypair", "ED25519", "DIGITAL_SIGNATURE", 0.97),
    ("crypto_secretbox", "ChaCha20", "SYMMETRIC_CIPHER", 0.90),
    ("crypto_stream_chacha20", "ChaCha20", "SYMMETRIC_CIPHER", 0.95),
    ("crypto_aead_aes256gcm_encrypt", "AES", "SYMMETRIC_CIPHER", 0.97),
    ("crypto_hash_sha256", "SHA-256", "HASH_FUNCTION", 0.95),
    ("crypto_hash_sha512", "SHA-512", "HASH_FUNCTION", 0.95),
    ("crypto_pwhash_argon2i", "Argon2", "KDF", 0.97),
    ("crypto_pwhash_argon2id", "Argon2", "KDF", 0.97),
    ("crypto_kdf_derive_from_key", "HKDF", "KDF", 0.90),
]

_MBEDTLS = [
    ("mbedtls_rsa_init", "RSA", "ASYMMETRIC_PKC", 0.93),
    ("mbedtls_rsa_gen_key", "RSA", "ASYMMETRIC_PKC", 0.95),
    ("mbedtls_rsa_public", "RSA", "ASYMMETRIC_PKC", 0.93),
    ("mbedtls_rsa_private", "RSA", "ASYMMETRIC_PKC", 0.93),
    ("mbedtls_aes_init", "AES", "SYMMETRIC_CIPHER", 0.93),
    ("mbedtls_aes_setkey_enc", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("mbedtls_aes_setkey_dec", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("mbedtls_aes_crypt_cbc", "AES", "SYMMETRIC_CIPHER", 0.95),
    ("mbedtls_sha256_init", "SHA-256", "HASH_FUNCTION", 0.93),
    ("mbedtls_sha256", "SHA-256", "HASH_FUNCTION", 0.95),
    ("mbedtls_sha512_init", "SHA-512", "HASH_FUNCTION", 0.93),
    ("mbedtls_md5_init", "MD5", "HASH_FUNCTION", 0.93),
    ("mbedtls_ecdsa_init", "ECDSA", "DIGITAL_SIGNATURE", 0.93),
    ("mbedtls_ecdh_init", "ECDH", "KEY_EXCHANGE", 0.93),
    ("mbedtls_ssl_init", "TLS", "PROTOCOL", 0.90),
    ("mbedtls_ssl_config_init", "TLS", "PROTOCOL", 0.90),
]

_WINDOWS_CNG = [
    ("BCryptGenerateSymmetricKey", "AES", "SYMMETRIC_CIPHER", 0.90),
    ("BCryptEncrypt", "AES", "SYMMETRIC_CIPHER", 0.88),
    ("BCryptDecrypt", "AES", "SYMMETRIC_CIPHER", 0.88),
    ("BCryptGenRandom", "RANDOM", "RANDOM", 0.90),
    ("BCryptCreateHash", "SHA-256", "HASH_FUNCTION", 0.88),
    ("BCryptHashData", "SHA-256", "HASH_FUNCTION", 0.85),
    ("BCryptOpenAlgorithmProvider", "AES", "SYMMETRIC_CIPHER", 0.80),
]

_WINDOWS_CRYPTOAPI = [
    ("CryptEncrypt", "RSA", "ASYMMETRIC_PKC", 0.88),
    ("CryptDecrypt", "RSA", "ASYMMETRIC_PKC", 0.88),
    ("CryptGenKey", "RSA", "ASYMMETRIC_PKC", 0.88),
    ("CryptHashData", "SHA-256", "HASH_FUNCTION", 0.85),
    ("CryptAcquireContextA", "RSA", "ASYMMETRIC_PKC", 0.78),
    ("CryptAcquireContextW", "RSA", "ASYMMETRIC_PKC", 0.78),
]

# prefix -> symbol whose meaning an unlisted symbol with that prefix takes; first match wins
SYMBOL_PREFIXES = [
    ("RSA_", "RSA_generate_key"),
    ("AES_", "AES_encrypt"),
    ("SHA256_", "SHA256_Init"),
    ("ECDSA_", "ECDSA_sign"),
    ("EVP_", "EVP_EncryptInit_ex"),
    ("mbedtls_rsa_", "mbedtls_rsa_init"),
    ("mbedtls_aes_", "mbedtls_aes_init"),
    ("crypto_sign_", "crypto_sign"),
]
# --- end of fixed values ----------------------------------------------------

_BY_LIBRARY = [
    ("OpenSSL", _OPENSSL),
    ("libsodium", _LIBSODIUM),
    ("mbedTLS", _MBEDTLS),
    ("Windows CNG", _WINDOWS_CNG),
    ("Windows CryptoAPI", _WINDOWS_CRYPTOAPI),
]


def symbol_rows() -> list[dict]:
    rows = []
    for library, known in _BY_LIBRARY:
        for symbol, algorithm, category, conf in known:
            rows.append({
                "symbol": symbol, "library": library, "algorithm": algorithm,
                "category": category, "confidence": conf,
            })
    return rows


def prefix_rows() -> list[dict]:
    by_symbol = {r["symbol"]: r for r in symbol_rows()}
    return [
        {
            "prefix": prefix, "prefix_ordinal": i, "library": by_symbol[s]["library"],
            "algorithm": by_symbol[s]["algorithm"], "category": by_symbol[s]["category"],
            "confidence": by_symbol[s]["confidence"],
        }
        for i, (prefix, s) in enumerate(SYMBOL_PREFIXES)
    ]
