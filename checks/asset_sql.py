"""The asset rules in plain SQL: facts -> classified -> scored -> timed -> advised."""

from __future__ import annotations

from checks.derived import ASSET_FACTS, for_duckdb

FACTS = f"facts AS ({for_duckdb(ASSET_FACTS)})"

# Family and kind of public key are worked out first, then strength by key or curve.
CLASSIFIED = """
hash_profile(h, status, cbits, qbits, vuln) AS (VALUES
  ('MD5','BROKEN',0,NULL,TRUE), ('SHA-1','BROKEN',0,NULL,TRUE), ('SHA-256','SECURE',128,85,TRUE),
  ('SHA-384','SECURE',192,128,FALSE), ('SHA-512','SECURE',256,171,FALSE), ('SHA-3','SECURE',NULL,NULL,FALSE)),
shaped AS (
  SELECT *, upper(algorithm) AS ua, coalesce(algorithm_family,'') AS fam,
    CASE WHEN primitive_type IN ('LIBRARY','CERTIFICATE','KEY_MATERIAL','RANDOM') THEN 'na'
         WHEN algorithm = 'Unknown Algorithm' THEN 'unk'
         WHEN algorithm IN ('ML-KEM','ML-DSA','SLH-DSA') THEN 'pqc'
         WHEN primitive_type = 'PROTOCOL' THEN 'proto'
         WHEN primitive_type = 'HASH_FUNCTION' THEN 'hash'
         WHEN primitive_type = 'SYMMETRIC_CIPHER' THEN
           CASE WHEN algorithm IN ('DES','RC4') THEN 'brokencipher' WHEN algorithm = '3DES' THEN '3des'
                WHEN upper(algorithm) LIKE '%CHACHA%' THEN 'chacha' WHEN upper(algorithm) LIKE 'AES%' THEN 'aes' ELSE 'unk' END
         WHEN primitive_type = 'MAC' THEN
           CASE WHEN algorithm LIKE 'Poly%' THEN 'poly' WHEN algorithm = 'CMAC' THEN 'cmac'
                WHEN algorithm = 'HMAC' THEN 'hmac' ELSE 'machash' END
         WHEN primitive_type = 'KDF' THEN CASE WHEN algorithm = 'Argon2' THEN 'argon' ELSE 'kdf' END
         WHEN primitive_type IN ('ASYMMETRIC_ENCRYPTION','DIGITAL_SIGNATURE','KEY_EXCHANGE') THEN
           CASE WHEN algorithm IN ('RSA','DSA','DH') THEN 'modulus'
                WHEN coalesce(algorithm_family,'') = 'ECC' THEN 'curve' ELSE 'otherpk' END
         ELSE 'unk' END AS grp,
    CASE algorithm WHEN 'HMAC-SHA1' THEN 'SHA-1' WHEN 'HMAC-SHA384' THEN 'SHA-384' ELSE algorithm END AS hname
  FROM facts),
graded AS (
  SELECT s.*, p.status AS hstatus, p.cbits, p.qbits, p.vuln,
    CASE WHEN key_length_bits IS NULL THEN 'UNKNOWN' WHEN key_length_bits >= 2048 THEN 'SECURE'
         WHEN key_length_bits >= 1024 THEN 'WEAK' ELSE 'BROKEN' END AS kstatus,
    CASE WHEN key_length_bits IS NULL THEN NULL WHEN key_length_bits >= 15360 THEN 256 WHEN key_length_bits >= 7680 THEN 192
         WHEN key_length_bits >= 4096 THEN 140 WHEN key_length_bits >= 3072 THEN 128 WHEN key_length_bits >= 2048 THEN 112
         WHEN key_length_bits >= 1024 THEN 80 ELSE 56 END AS kbits,
    CASE curve WHEN 'secp256r1' THEN 128 WHEN 'secp384r1' THEN 192 WHEN 'secp521r1' THEN 260 WHEN 'secp256k1' THEN 128
      WHEN 'Curve25519' THEN 128 WHEN 'Ed25519' THEN 128 WHEN 'brainpoolP256r1' THEN 128 WHEN 'brainpoolP384r1' THEN 192 WHEN 'brainpoolP512r1' THEN 256 END AS curvebits
  FROM shaped s LEFT JOIN hash_profile p ON p.h = s.hname AND s.grp IN ('hash','machash')),
classified AS (
  SELECT *,
    CASE grp WHEN 'na' THEN 'UNKNOWN' WHEN 'pqc' THEN 'SECURE' WHEN 'brokencipher' THEN 'BROKEN' WHEN '3des' THEN 'WEAK'
      WHEN 'chacha' THEN 'SECURE' WHEN 'aes' THEN 'SECURE' WHEN 'poly' THEN 'SECURE' WHEN 'cmac' THEN 'SECURE'
      WHEN 'argon' THEN 'SECURE' WHEN 'kdf' THEN 'SECURE' WHEN 'hash' THEN coalesce(hstatus,'UNKNOWN')
      WHEN 'machash' THEN hstatus WHEN 'modulus' THEN kstatus
      WHEN 'curve' THEN CASE WHEN curvebits IS NULL THEN 'UNKNOWN' ELSE 'SECURE' END ELSE 'UNKNOWN' END AS classical_security_status,
    CASE WHEN grp = 'na' OR grp = 'pqc' OR grp = 'chacha' OR grp = 'poly' OR grp = 'argon' THEN FALSE
         WHEN grp IN ('hash','machash') THEN vuln
         WHEN grp IN ('brokencipher','3des','modulus','curve','otherpk') THEN TRUE
         WHEN grp = 'aes' THEN CAST(floor(key_length_bits / 2) AS INT) < 128 END AS quantum_vulnerable,
    CASE WHEN grp IN ('na','proto') THEN 'NOT_APPLICABLE' WHEN grp IN ('pqc','argon') THEN 'QUANTUM_RESISTANT'
         WHEN grp = 'brokencipher' OR hstatus = 'BROKEN' THEN 'CLASSICALLY_BROKEN'
         WHEN grp IN ('3des','chacha','aes','poly','cmac','hmac','kdf') THEN 'GROVER_BIT_HALVING'
         WHEN grp IN ('modulus','curve','otherpk') THEN 'SHOR_POLYNOMIAL_BREAK'
         WHEN vuln THEN 'GROVER_BIT_HALVING' WHEN NOT vuln THEN 'QUANTUM_RESISTANT' ELSE 'UNKNOWN' END AS quantum_threat_type,
    CASE WHEN grp IN ('pqc','chacha','poly','argon') THEN 'SAFE'
         WHEN grp IN ('brokencipher','modulus','curve','otherpk') OR hstatus = 'BROKEN' THEN 'CRITICAL'
         WHEN grp = '3des' THEN 'DEGRADED'
         WHEN grp = 'aes' THEN CASE WHEN key_length_bits IS NULL THEN 'UNKNOWN' WHEN key_length_bits >= 256 THEN 'SAFE' ELSE 'DEGRADED' END
         WHEN vuln THEN 'DEGRADED' WHEN NOT vuln THEN 'SAFE' ELSE 'UNKNOWN' END AS quantum_security_status,
    CAST(CASE grp WHEN '3des' THEN 112 WHEN 'chacha' THEN 256 WHEN 'aes' THEN key_length_bits
      WHEN 'hash' THEN CASE WHEN hstatus <> 'BROKEN' THEN cbits END WHEN 'machash' THEN cbits
      WHEN 'modulus' THEN kbits WHEN 'curve' THEN curvebits END AS INT) AS effective_classical_security_bits,
    CAST(CASE grp WHEN '3des' THEN 56 WHEN 'chacha' THEN 128 WHEN 'aes' THEN CAST(floor(key_length_bits / 2) AS INT)
      WHEN 'hash' THEN qbits WHEN 'machash' THEN qbits END AS INT) AS effective_quantum_security_bits,
    CASE WHEN grp IN ('na','pqc','brokencipher','3des','chacha','poly','argon','machash') THEN 'HIGH'
      WHEN grp IN ('proto','cmac','hmac','kdf','otherpk') THEN 'LOW'
      WHEN grp = 'hash' THEN CASE WHEN hstatus IS NULL THEN 'UNKNOWN' ELSE 'HIGH' END
      WHEN grp IN ('aes','modulus') THEN CASE WHEN key_length_bits IS NULL THEN 'LOW' ELSE 'HIGH' END
      WHEN grp = 'curve' THEN CASE WHEN curve IS NULL THEN 'LOW' ELSE 'HIGH' END
      ELSE 'UNKNOWN' END AS classification_confidence
  FROM graded)
"""

SCORED = """
branched AS (
  SELECT *,
    CASE WHEN primitive_type IN ('LIBRARY','RANDOM') THEN 'none'
      WHEN classical_security_status = 'BROKEN' OR quantum_threat_type = 'CLASSICALLY_BROKEN'
           OR ua IN ('MD5','SHA-1','SHA1','DES','RC4','BLOWFISH') THEN 'broken'
      WHEN grp = 'pqc' THEN 'pqc'
      WHEN quantum_threat_type = 'SHOR_POLYNOMIAL_BREAK' OR quantum_security_status = 'CRITICAL' THEN 'shor'
      WHEN primitive_type = 'SYMMETRIC_CIPHER' THEN
        CASE WHEN ua LIKE '%3DES%' THEN '3des'
             WHEN key_length_bits = 256 OR ua LIKE '%CHACHA%' THEN '256'
             WHEN key_length_bits = 128 THEN '128' WHEN key_length_bits = 192 THEN '192' ELSE 'open' END
      WHEN primitive_type = 'HASH_FUNCTION' AND (ua LIKE '%384%' OR ua LIKE '%512%' OR ua LIKE '%SHA-3%') THEN 'hlong'
      WHEN primitive_type = 'HASH_FUNCTION' AND ua LIKE '%256%' THEN 'h256'
      WHEN primitive_type = 'HASH_FUNCTION' AND ua LIKE '%224%' THEN 'h224'
      WHEN primitive_type IN ('KDF','MAC') THEN CASE WHEN ua LIKE '%MD5%' OR ua LIKE '%SHA1%' OR ua LIKE '%SHA-1%' THEN 'kbroken' ELSE 'keyed' END
      WHEN primitive_type = 'PROTOCOL' THEN 'proto'
      ELSE 'unknown' END AS branch
  FROM classified),
scored AS (
  SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_severity
  FROM (SELECT *,
    CAST(CASE branch WHEN 'none' THEN 0 WHEN 'broken' THEN 100 WHEN 'pqc' THEN 0
      WHEN 'shor' THEN least(100, 90
           + CASE WHEN ua LIKE '%RSA%' AND key_length_bits < 2048 THEN 10 WHEN ua LIKE '%RSA%' AND key_length_bits >= 4096 THEN -5 ELSE 0 END
           + CASE WHEN upper(padding) LIKE '%PKCS1%' THEN 5 ELSE 0 END)
      WHEN '3des' THEN 75
      WHEN '256' THEN 10 + CASE WHEN upper(mode) = 'ECB' THEN 15 ELSE 0 END
      WHEN '128' THEN 70 + CASE WHEN upper(mode) = 'ECB' THEN 15 ELSE 0 END
      WHEN '192' THEN 55
      WHEN 'open' THEN 50 + CASE WHEN upper(mode) = 'ECB' THEN 15 ELSE 0 END
      WHEN 'hlong' THEN 15 WHEN 'h256' THEN 40 WHEN 'h224' THEN 65 WHEN 'kbroken' THEN 100 WHEN 'keyed' THEN 30
      WHEN 'proto' THEN 25 ELSE 50 END AS INT) AS risk_score
    FROM branched) b)
"""

# Expects a relation `timing(asset_id, algorithm, primitive_type, quantum_vulnerable, quantum_threat_type, x, y_given, z, hndl_sensitive)`.
TIMED_FROM_TIMING = """
t0 AS (
  SELECT *, NOT (primitive_type IN ('LIBRARY','RANDOM') OR upper(algorithm) LIKE 'ML-KEM%' OR upper(algorithm) LIKE 'ML-DSA%' OR upper(algorithm) LIKE 'SLH-DSA%') AS applicable,
    coalesce(y_given, CASE WHEN primitive_type IN ('ASYMMETRIC_ENCRYPTION','DIGITAL_SIGNATURE','KEY_EXCHANGE','CERTIFICATE','KEY_MATERIAL') THEN 4.0
      WHEN primitive_type = 'SYMMETRIC_CIPHER' THEN 1.5 WHEN primitive_type IN ('HASH_FUNCTION','MAC','KDF') THEN 1.0
      WHEN primitive_type = 'LIBRARY' THEN 2.0 ELSE 3.0 END) AS y
  FROM timing),
t1 AS (
  SELECT *, CASE WHEN applicable THEN x + y END AS x_plus_y,
    CASE WHEN applicable THEN x + y > z END AS inequality_triggered,
    CASE WHEN applicable AND x IS NOT NULL THEN greatest(0.0, x + y - z) END AS exposure_gap_years,
    CASE WHEN applicable AND x IS NOT NULL THEN z - y END AS migration_deadline_years,
    CASE WHEN NOT applicable THEN 'NONE' WHEN quantum_vulnerable IS NULL THEN 'UNKNOWN' WHEN NOT quantum_vulnerable THEN 'NONE'
      WHEN quantum_threat_type = 'GROVER_BIT_HALVING' THEN CASE WHEN hndl_sensitive IS TRUE THEN 'MEDIUM' ELSE 'LOW' END
      WHEN quantum_threat_type <> 'SHOR_POLYNOMIAL_BREAK' THEN 'UNKNOWN'
      WHEN x IS NULL THEN CASE WHEN hndl_sensitive IS TRUE THEN 'HIGH' ELSE 'UNKNOWN' END
      WHEN x < 1 THEN 'LOW'
      WHEN x - z > 5 THEN CASE WHEN hndl_sensitive IS FALSE THEN 'HIGH' ELSE 'CRITICAL' END
      WHEN x - z > 0 THEN 'HIGH' WHEN x - z > -3 THEN 'MEDIUM' ELSE 'LOW' END AS hndl_exposure
  FROM t0),
timed AS (
  SELECT *, CASE WHEN NOT applicable THEN 'NOT_REQUIRED' WHEN inequality_triggered IS NULL THEN 'UNKNOWN'
      WHEN inequality_triggered THEN CASE WHEN hndl_exposure = 'CRITICAL' OR exposure_gap_years <= 2 THEN 'IMMEDIATE' ELSE 'URGENT' END
      WHEN quantum_vulnerable IS TRUE THEN CASE WHEN z - y <= 3 OR hndl_exposure IN ('HIGH','CRITICAL') THEN 'PLANNED' ELSE 'MONITOR' END
      WHEN quantum_vulnerable IS FALSE THEN 'NOT_REQUIRED' ELSE 'UNKNOWN' END AS urgency
  FROM t1)
"""

TIMED = """
timing AS (SELECT asset_id, algorithm, primitive_type, quantum_vulnerable, quantum_threat_type,
                  x_years AS x, y_years AS y_given, coalesce(z_years, 10.0) AS z, hndl_sensitive FROM classified),
""" + TIMED_FROM_TIMING

ADVISED = """
routed AS (
  SELECT *,
    CASE WHEN algorithm = 'ML-KEM' THEN 'p203' WHEN algorithm = 'ML-DSA' THEN 'p204' WHEN algorithm = 'SLH-DSA' THEN 'p205'
      WHEN primitive_type IN ('LIBRARY','RANDOM','PROTOCOL') THEN 'none'
      WHEN primitive_type = 'HASH_FUNCTION' THEN CASE WHEN ua IN ('MD5','SHA-1') THEN 'hbroken'
           WHEN ua IN ('SHA-256','SHA-224','RIPEMD-160') THEN 'hup' ELSE 'hfine' END
      WHEN primitive_type = 'SYMMETRIC_CIPHER' THEN CASE WHEN ua IN ('DES','3DES','RC4') THEN 'cbroken'
           WHEN key_length_bits >= 256 THEN 'cfine' WHEN ua LIKE '%128%' OR key_length_bits < 256 THEN 'cup' ELSE 'copen' END
      WHEN primitive_type IN ('MAC','KDF') THEN CASE WHEN ua LIKE '%MD5%' OR ua LIKE '%SHA1%' THEN 'kbroken' ELSE 'none' END
      WHEN primitive_type = 'CERTIFICATE' THEN 'cert'
      WHEN algorithm = 'RSA' AND primitive_type = 'DIGITAL_SIGNATURE' THEN 'sigd'
      WHEN algorithm IN ('RSA','ElGamal') THEN 'enc'
      WHEN algorithm IN ('ECDSA','Ed25519') THEN 'sigh'
      WHEN algorithm = 'DSA' THEN 'sigd'
      WHEN algorithm IN ('DH','ECDH') THEN 'kex'
      ELSE 'unk' END AS route,
    coalesce(key_length_bits >= 3072, FALSE) OR coalesce(curve LIKE '%384%' OR curve LIKE '%521%', FALSE) AS strong
  FROM classified),
advised AS (
  SELECT asset_id, algorithm AS current_algorithm, primitive_type AS current_primitive,
    CASE WHEN route LIKE 'p20%' THEN 'ALREADY_PQC' WHEN route IN ('none','hfine','cfine') THEN 'NO_MIGRATION_REQUIRED'
      WHEN route IN ('hbroken','hup','cbroken','cup','kbroken') THEN 'CLASSICAL_UPGRADE'
      WHEN route IN ('cert','sigh','enc','kex') THEN 'HYBRID' WHEN route = 'sigd' THEN 'DIRECT_PQC' ELSE 'UNKNOWN' END AS recommendation_type,
    CASE WHEN route = 'hbroken' OR ua IN ('SHA-224','RIPEMD-160') THEN 'SHA-256' WHEN route = 'hup' THEN 'SHA-384'
      WHEN route IN ('cbroken','cup') THEN 'AES-256-GCM' WHEN route = 'kbroken' THEN 'HMAC-SHA-256'
      WHEN route IN ('cert','sigh','sigd') THEN CASE WHEN strong THEN 'ML-DSA-87' ELSE 'ML-DSA-65' END
      WHEN route = 'kex' THEN CASE WHEN strong THEN 'ML-KEM-1024' ELSE 'ML-KEM-768' END
      WHEN route = 'enc' THEN CASE WHEN key_length_bits >= 3072 THEN 'ML-KEM-1024' ELSE 'ML-KEM-768' END END AS recommended_algorithm,
    CASE WHEN route IN ('p203','enc','kex') THEN 'NIST FIPS 203' WHEN route IN ('p204','cert','sigh','sigd') THEN 'NIST FIPS 204'
      WHEN route = 'p205' THEN 'NIST FIPS 205' END AS pqc_standard,
    CASE WHEN route IN ('enc','kex') THEN 'X25519 + ML-KEM-768' WHEN route IN ('cert','sigh') THEN 'Ed25519 + ML-DSA-65' END AS hybrid_recommendation,
    CASE WHEN route IN ('copen','unk') THEN 'INSUFFICIENT_DATA' ELSE 'HIGH' END AS confidence,
    CASE WHEN route IN ('hbroken','hup','cbroken','kbroken','unk') THEN 'MEDIUM' WHEN route IN ('cert','sigh','sigd','enc','kex') THEN 'HIGH' ELSE 'LOW' END AS migration_complexity
  FROM routed)
"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select
