"""Replacement advice per asset: a rule id, a parameter set, then a decision table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.dims import policy, small
from keystrata.functions.binding import bind
from keystrata.functions.naming import contains_any
from keystrata.functions.text import lookup


def _alg() -> Column:
    return F.col("_ua")


def _has(*parts: str) -> Column:
    return contains_any(_alg(), list(parts))


def _family_of(name: Column) -> Column:
    """Name up to the first -, else up to the first _, else up to the first /."""
    cut = F.when(F.contains(name, F.lit("-")), "-").when(F.contains(name, F.lit("_")), "_").otherwise("/")
    return F.split_part(name, cut, F.lit(1))


def _family() -> Column:
    return F.col("_first")


def _signature_rule() -> Column:
    return F.when(_has("ECDSA", "ED25519", "ED448"), "signature:hybrid").otherwise("signature:direct")


def with_recommendation_rule(assets: DataFrame) -> DataFrame:
    """Adds ``_rule``, the first rule that applies; risk and urgency play no part in it."""
    prim, key = F.col("primitive_type"), F.col("key_length_bits")
    shor = F.coalesce(F.col("quantum_threat_type") == "SHOR_POLYNOMIAL_BREAK", F.lit(False))
    broken = F.trim(_alg()).isin(policy.BROKEN_NAMES_FOR_REPLACEMENT)
    short_key = F.coalesce(key < 256, F.lit(False))
    long_key = F.coalesce(key >= 256, F.lit(False))
    df = bind(assets, _ua=F.upper("algorithm"))
    df = bind(df, _first=_family_of(F.trim(_alg())), _broken=broken)
    df = bind(
        df,
        _rsa=_family().isin(policy.ENCRYPTION_FAMILIES) | _has("RSA"),
        _exchange=_family().isin(policy.KEY_EXCHANGE_FAMILIES),
        _dh=_has("DH"),
        _signs=_family().isin(policy.SIGNATURE_FAMILIES) | _has("DSA"),
        _sign_rule=_signature_rule(),
    )
    rsa, exchange, dh, signs = F.col("_rsa"), F.col("_exchange"), F.col("_dh"), F.col("_signs")
    df = bind(
        df,
        _public=F.when(prim == "CERTIFICATE", "certificate")
        .when(prim == "KEY_MATERIAL",
              F.when(rsa, "encryption").when(exchange | dh, "exchange")
              .when(signs | _has("ED25519"), F.col("_sign_rule")).otherwise("unknown"))
        .when(prim == "DIGITAL_SIGNATURE",
              F.when(rsa | signs | _has("ED") | shor, F.col("_sign_rule")).otherwise("unknown"))
        .when(prim == "KEY_EXCHANGE",
              F.when(rsa, "encryption").when(exchange | dh | shor, "exchange").otherwise("unknown"))
        .when(prim == "ASYMMETRIC_ENCRYPTION",
              F.when(rsa, "encryption").when(exchange | _has("ECDH"), "exchange")
              .when(shor, "encryption").otherwise("unknown")),
    )
    rule = (
        F.when(F.startswith(_alg(), F.lit("ML-KEM")), "pqc:203")
        .when(F.startswith(_alg(), F.lit("ML-DSA")), "pqc:204")
        .when(F.startswith(_alg(), F.lit("SLH-DSA")), "pqc:205")
        .when(prim.isin("LIBRARY", "RANDOM", "PROTOCOL"), "none")
        .when(prim == "HASH_FUNCTION",
              F.when(F.col("_broken"), "hash:broken")
              .when(_alg().isin(list(policy.HASH_UPGRADES)), "hash:upgrade")
              .otherwise("hash:fine"))
        .when(prim == "SYMMETRIC_CIPHER",
              F.when(F.col("_broken"), "cipher:broken")
              .when(long_key, "cipher:fine")
              .when(_alg().isin(list(policy.CIPHER_UPGRADES)) | _has("128") | short_key, "cipher:upgrade")
              .otherwise("cipher:?"))
        .when(prim.isin("MAC", "KDF"), F.when(_has("MD5", "SHA1", "SHA-1"), "keyed:broken").otherwise("none"))
        .otherwise(F.coalesce("_public", F.lit("unknown")))
    )
    return bind(df, _rule=rule)


def _parameter_set(rule: Column) -> Column:
    """struct<name, category> of the lattice scheme that matches the present strength.
    For encryption the curve is not looked at."""
    strong_curve = F.coalesce(F.col("curve").rlike("384|521|448"), F.lit(False)) & (rule != "encryption")
    high = strong_curve | F.coalesce(F.col("key_length_bits") >= policy.HIGH_SECURITY_MODULUS, F.lit(False))
    pick = lambda kind: F.when(high, _set(f"{kind}:high")).otherwise(_set(kind))
    return F.when(rule.isin("exchange", "encryption"), pick("kem")).when(
        F.startswith(rule, F.lit("signature")) | (rule == "certificate"), pick("dsa")
    )


def _set(name: str) -> Column:
    label, category = policy.PARAMETER_SETS[name]
    return F.struct(F.lit(label).alias("name"), F.lit(category).alias("category"))


def recommend(assets: DataFrame, explain: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Recommendation per asset; the columns in ``keep`` pass through. MACs and KDFs count as broken when their name holds a
    broken hash anywhere. Needs quantum_threat_type."""
    dim = small(assets.sparkSession, policy.recommendation_rows())
    df = with_recommendation_rule(
        assets.select("asset_id", "algorithm", "primitive_type", "key_length_bits", "curve", "quantum_threat_type", *keep)
    )
    df = bind(df, _set=_parameter_set(F.col("_rule")))
    df = df.join(dim, df["_rule"] == dim["rule"], "left")
    target = (
        F.when(F.col("_rule").isin("hash:broken", "hash:upgrade"),
               F.coalesce(lookup(_alg(), policy.HASH_UPGRADES), F.col("fixed_target")))
        .when(F.col("_rule") == "cipher:upgrade",
              F.coalesce(lookup(_alg(), policy.CIPHER_UPGRADES), F.col("fixed_target")))
        .otherwise(F.coalesce("_set.name", "fixed_target"))
    )
    df = bind(df, recommended_algorithm=target)
    base = [
        "asset_id", F.col("algorithm").alias("current_algorithm"), F.col("primitive_type").alias("current_primitive"),
        "recommendation_type", "recommended_algorithm", "pqc_standard", "hybrid_recommendation", "confidence",
        "migration_complexity", *keep,
    ]
    if not explain:
        return df.select(*base)
    fill = lambda c: F.transform(c, lambda t: F.replace(
        F.replace(t, F.lit("{algorithm}"), F.col("algorithm")), F.lit("{target}"),
        F.coalesce("recommended_algorithm", F.lit("a replacement"))))
    no_key = F.col("key_length_bits").isNull()
    blind = no_key & (F.col("curve").isNull() | (F.col("_rule") == "encryption"))
    chosen = F.col("_set").isNotNull()
    assumptions = F.array_compact(F.array(
        F.when((chosen & blind) | (F.col("_rule") == "cipher:?"), F.lit("no key length is known")),
        F.when(chosen, F.format_string("%s is of security category %d", "_set.name", "_set.category")),
        F.when(F.col("hybrid_recommendation").isNotNull(), F.lit("a hybrid period precedes the final switch")),
    ))
    open_curve = (F.col("_rule") == "exchange") & F.col("curve").isNull() & _has("EC")
    limits = F.array_compact(F.array(
        F.when(chosen & blind & (F.col("_rule") != "certificate"), F.lit("key length unknown")),
        F.when(open_curve, F.lit("curve unknown")),
    ))
    return df.select(
        *base, fill(F.col("rationale")).alias("rationale"), assumptions.alias("assumptions"),
        F.concat(fill(F.col("limitations")), limits).alias("limitations"), fill(F.col("guidance")).alias("guidance_steps"),
    )


def recommendation_report(recs: DataFrame) -> DataFrame:
    """Counts per recommendation type in one row."""
    return recs.agg(
        F.count(F.lit(1)).alias("total_assets"),
        *[F.count_if(F.col("recommendation_type") == t).alias(f"{t.lower()}_count") for t in policy.RECOMMENDATION_TYPES],
    )


def recommendation_distributions(recs: DataFrame) -> DataFrame:
    """(dimension, value, n) by target, current algorithm and primitive, in one aggregation."""
    out = recs.groupingSets(
        [["recommended_algorithm"], ["current_algorithm"], ["current_primitive"]],
        "recommended_algorithm", "current_algorithm", "current_primitive",
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    named = out.select(
        F.when(F.col("g") == 3, "recommended_algorithm")
        .when(F.col("g") == 5, "current_algorithm")
        .otherwise("current_primitive")
        .alias("dimension"),
        F.coalesce("recommended_algorithm", "current_algorithm", "current_primitive").alias("value"),
        "n",
    )
    return named.where(F.col("value").isNotNull())
