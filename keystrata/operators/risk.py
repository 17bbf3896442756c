"""Risk score 0-100 with itemised factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.dims import policy, small
from keystrata.functions.binding import bind
from keystrata.functions.naming import contains_any, is_pqc
from keystrata.functions.scoring import clamp, severity
from keystrata.operators.classify import with_upper

_SHOR, _RESISTANT, _BROKEN = "SHOR_POLYNOMIAL_BREAK", "QUANTUM_RESISTANT", "CLASSICALLY_BROKEN"


def _alg() -> Column:
    return F.col("_ua")


def _has(*parts: str) -> Column:
    return contains_any(_alg(), list(parts))


def _is(column: str, value: str) -> Column:
    """Equality that treats null as different."""
    return F.coalesce(F.col(column) == value, F.lit(False))


def with_risk_rule(assets: DataFrame) -> DataFrame:
    """Adds ``_rule``, the branch an asset is scored by; the first that applies, in order."""
    prim, key = F.col("primitive_type"), F.col("key_length_bits")
    key_is = lambda n: F.coalesce(key == n, F.lit(False))
    safe_chacha = _is("quantum_security_status", "SAFE") & (_has("CHACHA") | _is("algorithm_family", "CHACHA"))
    df = bind(
        with_upper(assets),
        _broken=_is("classical_security_status", "BROKEN") | _is("quantum_threat_type", _BROKEN)
        | F.upper("algorithm").isin(policy.BROKEN_NAMES_FOR_RISK),
        _shor=_is("quantum_threat_type", _SHOR) | _is("quantum_security_status", "CRITICAL"),
        _pqc=is_pqc(F.col("algorithm")) | (
            _is("quantum_threat_type", _RESISTANT) & _is("quantum_security_status", "SAFE")
            & prim.isin("ASYMMETRIC_ENCRYPTION", "DIGITAL_SIGNATURE", "KEY_EXCHANGE")
        ),
    )
    df = bind(
        df,
        _cipher=F.when(_has("3DES", "DES3", "TRIPLEDES"), "3des")
        .when(key_is(256) | safe_chacha, "cipher:256")
        .when(key_is(128), "cipher:128")
        .when(key_is(192), "cipher:192")
        .otherwise("cipher:?"),
        _hash=F.when(_has("384", "512", "SHA3", "SHA-3"), "hash:long")
        .when(_has("256"), "hash:256")
        .when(_has("224"), "hash:224"),
    )
    rule = (
        F.when(prim.isin("LIBRARY", "RANDOM"), "none")
        .when(F.col("_broken"), "broken")
        .when(F.col("_pqc"), "pqc")
        .when(F.col("_shor"), "shor")
        .when(prim == "SYMMETRIC_CIPHER", F.col("_cipher"))
        .when(prim == "HASH_FUNCTION", F.coalesce("_hash", F.lit("unknown")))
        .when(prim.isin("KDF", "MAC"), F.when(_has("MD5", "SHA1", "SHA-1"), "keyed:broken").otherwise("keyed"))
        .when(prim == "PROTOCOL",
              F.when(_is("classical_security_status", "BROKEN"), "protocol:broken")
              .when(_is("classical_security_status", "WEAK"), "protocol:weak")
              .otherwise("protocol"))
        .otherwise("unknown")
    )
    return bind(df, _rule=rule)


def _modifiers(rule: Column) -> list[tuple[Column, str, Column, float, str, str]]:
    """(condition, name, score, maximum, field, reason) of the parameter factors."""
    key = F.col("key_length_bits")
    shor, rsa = rule == "shor", _has("RSA")
    curved = contains_any(F.col("_uf"), ["ECC", "ECDSA", "ECDH"]) | _has(
        "ECC", "ECDSA", "ECDH"
    )
    ecb = rule.isin("cipher:256", "cipher:128", "cipher:?") & F.coalesce(F.upper("mode") == "ECB", F.lit(False))
    pkcs1 = F.coalesce(F.contains(F.upper("padding"), F.lit("PKCS1")), F.lit(False))
    return [
        (shor & rsa & F.coalesce(key < 2048, F.lit(False)), "parameter_key_length", F.lit(policy.MOD_SHORT_RSA), 10.0,
         "key_length_bits", "modulus shorter than 2048 bits"),
        (shor & rsa & F.coalesce(key >= 4096, F.lit(False)), "parameter_key_length", F.lit(policy.MOD_LONG_RSA), 0.0,
         "key_length_bits", "modulus of at least 4096 bits"),
        (shor & rsa & key.isNull(), "parameter_key_length", F.lit(0.0), 0.0,
         "key_length_bits", "no key length was found; none is assumed"),
        (shor & ~rsa & curved & F.col("curve").isNull(), "parameter_curve", F.lit(0.0), 0.0,
         "curve", "no curve was found; none is assumed"),
        (shor & pkcs1, "parameter_padding", F.lit(policy.MOD_PKCS1), 5.0,
         "padding", "PKCS#1 v1.5 padding allows padding-oracle attacks"),
        (ecb, "parameter_cipher_mode", F.lit(policy.MOD_ECB), 15.0,
         "mode", "ECB mode shows repeated plaintext blocks"),
    ]


def _scored(assets: DataFrame) -> DataFrame:
    """Adds ``_rule``, the rule's base columns and risk_score."""
    dim = small(assets.sparkSession, policy.risk_rows())
    df = with_risk_rule(assets)
    df = df.join(dim, df["_rule"] == dim["rule"], "left")
    total = F.col("base_score")
    for condition, _, value, *_rest in _modifiers(F.col("_rule")):
        total = total + F.when(condition, value).otherwise(0.0)
    df = bind(df, _total=total)
    return bind(df, risk_score=F.round(clamp(F.col("_total"), 0.0, 100.0)).cast("int"))


def score_risk(assets: DataFrame, explain: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """asset_id, risk_score, severity (and with ``explain`` factors, rationale, confidence).

    The score is the sum of the factors, clamped to 0-100. Discovery confidence is passed
    on and never scales the score. Needs the classification columns; those in ``keep`` pass
    through.
    """
    df = _scored(assets)
    base = [F.col("asset_id"), F.col("risk_score"), severity(F.col("risk_score")).alias("severity"), *keep]
    if not explain:
        return df.select(*base)
    modifiers = _modifiers(F.col("_rule"))
    factors = F.concat(
        F.transform("base_factors", lambda f: F.struct(
            f["name"].alias("name"), f["score"].alias("score"), f["maximum"].alias("maximum"),
            F.replace(f["reason"], F.lit("{algorithm}"), F.col("algorithm")).alias("reason"),
            f["source_field"].alias("source_field"),
        )),
        F.array_compact(F.array(*[
            F.when(cond, F.struct(
                F.lit(name).alias("name"), value.alias("score"), F.lit(maximum).alias("maximum"),
                F.lit(reason).alias("reason"), F.lit(field).alias("source_field"),
            ))
            for cond, name, value, maximum, field, reason in modifiers
        ])),
    )
    return df.select(
        *base, factors.alias("factors"),
        F.replace(F.col("base_factors")[0]["reason"], F.lit("{algorithm}"), F.col("algorithm")).alias("rationale"),
        F.col("confidence_score").alias("confidence"),
    )


def risk_factors(risk: DataFrame) -> DataFrame:
    """One row per asset and factor, for audits."""
    return risk.select("asset_id", F.posexplode("factors").alias("factor_no", "factor")).select(
        "asset_id", "factor_no", "factor.*"
    )


def with_risk(assets: DataFrame) -> DataFrame:
    """Assets with risk_score and risk_severity. The score depends on the asset's own row,
    so it is computed beside it rather than joined back."""
    df = _scored(assets)
    return df.select(*assets.columns, "risk_score", severity(F.col("risk_score")).alias("risk_severity"))


def risk_report(scored: DataFrame) -> DataFrame:
    """One summary row over assets that carry classification and risk columns."""
    is_true = lambda c: F.coalesce(c, F.lit(False))
    broken = _is("classical_security_status", "BROKEN")
    shor = _is("quantum_threat_type", _SHOR)
    vulnerable = is_true(F.col("quantum_vulnerable"))
    not_vulnerable = is_true(F.col("quantum_vulnerable") == F.lit(False))
    out = scored.agg(
        F.coalesce(F.round(clamp(
            policy.OVERALL_MAX_WEIGHT * F.max("risk_score") + policy.OVERALL_MEAN_WEIGHT * F.avg("risk_score"), 0.0, 100.0
        ), 1), F.lit(0.0)).alias("overall_risk_score"),
        F.count(F.lit(1)).alias("total_assets_discovered"),
        F.count_if((F.col("risk_score") >= 60) | vulnerable | broken).alias("vulnerable_assets_count"),
        F.count_if(shor).alias("shor_vulnerable_count"),
        F.count_if(~shor & _is("quantum_threat_type", "GROVER_BIT_HALVING") & vulnerable).alias("grover_impacted_count"),
        F.count_if(broken | _is("quantum_threat_type", _BROKEN)).alias("classically_broken_count"),
        F.count_if(
            _is("quantum_threat_type", _RESISTANT) | (not_vulnerable & _is("classical_security_status", "SECURE"))
        ).alias("quantum_resistant_count"),
        *[F.count_if(F.col("risk_severity") == s).alias(f"severity_{s.lower()}") for s in
          ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )
    return out.withColumn("overall_severity", severity(F.col("overall_risk_score")))
