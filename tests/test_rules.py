"""Boundary rows of classification, risk, timeline and recommendation."""

import pytest

from keystrata.operators import recommend, risk, timeline
from keystrata.operators.classify import classify

COLUMNS = "asset_id string, algorithm string, algorithm_family string, primitive_type string, key_length_bits int, curve string, mode string, padding string, confidence_score double"


def assets(spark, rows):
    return spark.createDataFrame([
        (str(i), a, f, p, k, c, m, pad, 0.5) for i, (a, f, p, k, c, m, pad) in enumerate(rows)
    ], COLUMNS)


def asset(a, f, p, k=None, c=None, m=None, pad=None):
    return (a, f, p, k, c, m, pad)


ASYM, SIG, KEX, SYM, HASH = "ASYMMETRIC_ENCRYPTION", "DIGITAL_SIGNATURE", "KEY_EXCHANGE", "SYMMETRIC_CIPHER", "HASH_FUNCTION"
# asset -> (classical status, vulnerable, classical bits, quantum bits, risk score, recommendation type, target)
CASES = [
    (asset("RSA", "RSA", ASYM), ("UNKNOWN", True, None, None, 90, "HYBRID", "ML-KEM-768")),
    (asset("RSA", "RSA", ASYM, 512), ("BROKEN", True, 56, None, 100, "HYBRID", "ML-KEM-768")),
    (asset("RSA", "RSA", ASYM, 300), ("BROKEN", True, 56, None, 100, "HYBRID", "ML-KEM-768")),
    (asset("RSA", "RSA", ASYM, 1024), ("WEAK", True, 80, None, 100, "HYBRID", "ML-KEM-768")),
    (asset("RSA", "RSA", ASYM, 2048), ("SECURE", True, 112, None, 90, "HYBRID", "ML-KEM-768")),
    (asset("RSA", "RSA", ASYM, 3072), ("SECURE", True, 128, None, 90, "HYBRID", "ML-KEM-1024")),
    (asset("RSA", "RSA", ASYM, 4096, None, None, "PKCS1v15"), ("SECURE", True, 140, None, 90, "HYBRID", "ML-KEM-1024")),
    (asset("RSA", "RSA", SIG, 15360), ("SECURE", True, 256, None, 85, "DIRECT_PQC", "ML-DSA-87")),
    (asset("AES", "AES", SYM), ("SECURE", None, None, None, 50, "UNKNOWN", None)),
    (asset("AES", "AES", SYM, None, None, "ECB"), ("SECURE", None, None, None, 65, "UNKNOWN", None)),
    (asset("AES-128", "AES", SYM, 128), ("SECURE", True, 128, 64, 70, "CLASSICAL_UPGRADE", "AES-256")),
    (asset("AES-128-ECB", "AES", SYM, 128, None, "ecb"), ("SECURE", True, 128, 64, 85, "CLASSICAL_UPGRADE", "AES-256-GCM")),
    (asset("AES-192", "AES", SYM, 192, None, "ECB"), ("SECURE", True, 192, 96, 55, "CLASSICAL_UPGRADE", "AES-256-GCM")),
    (asset("AES-256", "AES", SYM, 256), ("SECURE", False, 256, 128, 10, "NO_MIGRATION_REQUIRED", None)),
    (asset("ECDSA", "ECC", SIG), ("UNKNOWN", True, None, None, 90, "HYBRID", "ML-DSA-65")),
    (asset("ECDSA", "ECC", SIG, None, "secp256r1"), ("SECURE", True, 128, None, 90, "HYBRID", "ML-DSA-65")),
    (asset("ECDSA", "ECC", SIG, None, "secp384r1"), ("SECURE", True, 192, None, 90, "HYBRID", "ML-DSA-87")),
    (asset("ECDSA", "ECC", SIG, None, "strange"), ("UNKNOWN", True, None, None, 90, "HYBRID", "ML-DSA-65")),
    (asset("ECDH", "ECC", KEX, None, "Curve25519"), ("SECURE", True, 128, None, 90, "HYBRID", "ML-KEM-768")),
    (asset("MD5", "MD5", HASH), ("BROKEN", True, None, None, 100, "CLASSICAL_UPGRADE", "SHA-256")),
    (asset("SHA-1", "SHA", HASH), ("BROKEN", True, None, None, 100, "CLASSICAL_UPGRADE", "SHA-256")),
    (asset("SHA-256", "SHA", HASH), ("SECURE", True, 128, 85, 40, "CLASSICAL_UPGRADE", "SHA-384")),
    (asset("SHA-224", "SHA", HASH), ("UNKNOWN", None, None, None, 65, "CLASSICAL_UPGRADE", "SHA-256")),
    (asset("SHA-384", "SHA", HASH), ("SECURE", False, 192, 128, 15, "NO_MIGRATION_REQUIRED", None)),
    (asset("SHA-3", "SHA", HASH), ("SECURE", False, None, None, 15, "NO_MIGRATION_REQUIRED", None)),
    (asset("3DES", "3DES", SYM), ("WEAK", True, 112, 56, 75, "CLASSICAL_UPGRADE", "AES-256-GCM")),
    (asset("DES", "DES", SYM), ("BROKEN", True, None, None, 100, "CLASSICAL_UPGRADE", "AES-256-GCM")),
    (asset("RC4", "RC4", SYM), ("BROKEN", True, None, None, 100, "CLASSICAL_UPGRADE", "AES-256-GCM")),
    (asset("ChaCha20", "CHACHA20", SYM), ("SECURE", False, 256, 128, 10, "UNKNOWN", None)),
    (asset("HMAC", "HMAC", "MAC"), ("UNKNOWN", None, None, None, 30, "NO_MIGRATION_REQUIRED", None)),
    (asset("HMAC-MD5", "HMAC", "MAC"), ("BROKEN", True, 0, None, 100, "CLASSICAL_UPGRADE", "HMAC-SHA-256")),
    (asset("Argon2", "ARGON2", "KDF"), ("SECURE", False, None, None, 30, "NO_MIGRATION_REQUIRED", None)),
    (asset("TLS", "TLS", "PROTOCOL"), ("UNKNOWN", None, None, None, 25, "NO_MIGRATION_REQUIRED", None)),
    (asset("SSL", "SSL", "PROTOCOL"), ("UNKNOWN", None, None, None, 25, "NO_MIGRATION_REQUIRED", None)),
    (asset("ML-KEM-768", "ML-KEM", KEX), ("SECURE", False, None, None, 0, "ALREADY_PQC", None)),
    (asset("SLH-DSA", "SLH-DSA", SIG), ("SECURE", False, None, None, 0, "ALREADY_PQC", None)),
    (asset("Library: OpenSSL", "LIBRARY", "LIBRARY"), ("UNKNOWN", False, None, None, 0, "NO_MIGRATION_REQUIRED", None)),
    (asset("CSPRNG", "RANDOM", "RANDOM"), ("UNKNOWN", False, None, None, 0, "NO_MIGRATION_REQUIRED", None)),
    (asset("X.509 Certificate", "CERTIFICATE", "CERTIFICATE"), ("UNKNOWN", False, None, None, 50, "HYBRID", "ML-DSA-65")),
    (asset("RSA", "RSA", "KEY_MATERIAL"), ("UNKNOWN", False, None, None, 50, "HYBRID", "ML-KEM-768")),
    (asset("Unknown Algorithm", None, "UNKNOWN"), ("UNKNOWN", None, None, None, 50, "UNKNOWN", None)),
]


def test_rule_tables(spark):
    classified = classify(assets(spark, [c[0] for c in CASES]))
    scores = {r.asset_id: r for r in risk.score_risk(classified).collect()}
    recs = {r.asset_id: r for r in recommend.recommend(classified).collect()}
    wide = {r.asset_id: r for r in risk.with_risk(classified).collect()}
    for row in classified.collect():
        case, want = CASES[int(row.asset_id)]
        got = (
            row.classical_security_status, row.quantum_vulnerable, row.effective_classical_security_bits,
            row.effective_quantum_security_bits, scores[row.asset_id].risk_score,
            recs[row.asset_id].recommendation_type, recs[row.asset_id].recommended_algorithm,
        )
        assert got == want, case
        score = scores[row.asset_id]
        assert score.risk_score == max(0, min(100, sum(f.score for f in score.factors)))
        assert 0 <= score.risk_score <= 100 and wide[row.asset_id].risk_score == score.risk_score
        assert row.classification_notes.startswith(f"[{row.classification_confidence}] Classical [")
        assert recs[row.asset_id].guidance_steps and recs[row.asset_id].rationale
        assert all("{" not in t for t in [*recs[row.asset_id].rationale, *recs[row.asset_id].guidance_steps, score.rationale])


SHOR, GROVER = "SHOR_POLYNOMIAL_BREAK", "GROVER_BIT_HALVING"
# (primitive, vulnerable, threat, x, y, z, sensitive) -> (triggered, gap, exposure, urgency)
TIMES = [
    ((ASYM, True, SHOR, 6.0, 4.0, 10.0, None), (False, 0.0, "LOW", "MONITOR")),
    ((ASYM, True, SHOR, 8.0, 4.0, 10.0, None), (True, 2.0, "MEDIUM", "IMMEDIATE")),
    ((ASYM, True, SHOR, 8.5, 4.0, 10.0, None), (True, 2.5, "MEDIUM", "URGENT")),
    ((ASYM, True, SHOR, 1.0, 7.0, 10.0, None), (False, 0.0, "LOW", "PLANNED")),
    ((ASYM, True, SHOR, 1.0, 6.9, 10.0, None), (False, 0.0, "LOW", "MONITOR")),
    ((ASYM, True, SHOR, 15.0, 4.0, 10.0, None), (True, 9.0, "HIGH", "URGENT")),
    ((ASYM, True, SHOR, 15.5, 4.0, 10.0, None), (True, 9.5, "CRITICAL", "IMMEDIATE")),
    ((ASYM, True, SHOR, 15.5, 4.0, 10.0, False), (True, 9.5, "HIGH", "URGENT")),
    ((ASYM, True, SHOR, 10.0, 4.0, 10.0, None), (True, 4.0, "MEDIUM", "URGENT")),
    ((ASYM, True, SHOR, 7.0, 1.0, 10.0, None), (False, 0.0, "LOW", "MONITOR")),
    ((ASYM, True, SHOR, 0.5, 4.0, 10.0, True), (False, 0.0, "LOW", "MONITOR")),
    ((ASYM, True, SHOR, None, 4.0, 10.0, True), (None, None, "HIGH", "UNKNOWN")),
    ((ASYM, True, SHOR, None, 4.0, 10.0, None), (None, None, "UNKNOWN", "UNKNOWN")),
    ((SYM, True, GROVER, 9.0, None, 10.0, True), (True, 0.5, "MEDIUM", "IMMEDIATE")),
    ((SYM, False, GROVER, 9.0, None, 10.0, None), (True, 0.5, "NONE", "IMMEDIATE")),
    ((SYM, False, GROVER, 1.0, None, None, None), (False, 0.0, "NONE", "NOT_REQUIRED")),
    ((HASH, True, "CLASSICALLY_BROKEN", 1.0, None, None, None), (False, 0.0, "UNKNOWN", "MONITOR")),
    (("LIBRARY", False, None, 50.0, None, None, None), (None, None, "NONE", "NOT_REQUIRED")),
    (("PROTOCOL", None, None, 1.0, None, None, None), (False, 0.0, "UNKNOWN", "UNKNOWN")),
    ((ASYM, True, SHOR, 1.0, None, 0.0, None), (True, 5.0, "HIGH", "URGENT")),
]


def test_timeline(spark):
    rows = [(str(i), "X", p, v, t) for i, ((p, v, t, *_), _) in enumerate(TIMES)]
    df = spark.createDataFrame(rows, "asset_id string, algorithm string, primitive_type string, quantum_vulnerable boolean, quantum_threat_type string")
    given = [(str(i), y, z, x, s, None) for i, ((_, _, _, x, y, z, s), _) in enumerate(TIMES)]
    inputs = spark.createDataFrame(given, "asset_id string, migration_time_years double, quantum_arrival_years double, protected_lifetime_years double, hndl_sensitive boolean, assessment_date date")
    for row in timeline.assess_timeline(df, inputs).collect():
        case, want = TIMES[int(row.asset_id)]
        assert (row.inequality_triggered, row.exposure_gap_years, row.hndl_exposure, row.urgency) == want, case
        assert row.rationale and row.assumptions is not None


def test_timeline_defaults_off(spark):
    df = assets(spark, [asset("RSA", "RSA", ASYM)])
    config = timeline.TimelineConfig(protected_lifetime_years=9.0, use_primitive_defaults=False)
    row = timeline.assess_timeline(classify(df), None, config).first()
    assert row.y_migration_time_years is None and row.inequality_triggered is None and row.urgency == "UNKNOWN"


@pytest.mark.parametrize("report", [risk.risk_report, timeline.timeline_report, recommend.recommendation_report])
def test_empty_reports_have_one_zero_row(spark, report):
    none = risk.with_risk(classify(assets(spark, [asset("RSA", "RSA", ASYM)]).where("false")))
    source = {timeline.timeline_report: lambda d: timeline.assess_timeline(d), recommend.recommendation_report: lambda d: recommend.recommend(d)}
    rows = report(source.get(report, lambda d: d)(none)).collect()
    assert len(rows) == 1 and all(v in (0, 0.0, "LOW") for v in rows[0])
