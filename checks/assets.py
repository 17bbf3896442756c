"""Checks of the asset stages: classification, risk, timeline, advice, components, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import asset_sql as A
from checks.derived import asset_facts, timeline_inputs, with_location
from keystrata.operators import components, listing, quality, recommend, reports, risk, timeline
from keystrata.operators.classify import CLASSIFIED, classify

XS = [1, 3, 5, 10, 15, 20, 25]
ZS = [7, 10, 15]

QUERIES, SQL = {}, {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify(asset_facts(spark, sf), notes=False)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return risk.with_risk(classified(spark, sf))


def timed(spark: SparkSession, sf: str) -> DataFrame:
    facts = asset_facts(spark, sf)
    return timeline.assess_timeline(classify(facts, notes=False), timeline_inputs(facts), explain=False)


def advised(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.recommend(classified(spark, sf), explain=False)


_C = (A.FACTS, A.CLASSIFIED)
_S = (*_C, A.SCORED)
_T = (*_C, A.TIMED)
_R = (*_C, A.ADVISED)


@check("classify", A.with_ctes(*_C, select="SELECT asset_id, " + ", ".join(CLASSIFIED) + " FROM classified"))
def _(spark, sf):
    return classified(spark, sf).select("asset_id", *CLASSIFIED)


@check("classification_summary", A.with_ctes(*_C, select="""
SELECT quantum_threat_type, classical_security_status, quantum_security_status, count(*) AS n,
       count(CASE WHEN quantum_vulnerable THEN 1 END) AS vulnerable FROM classified GROUP BY ALL"""))
def _(spark, sf):
    return classified(spark, sf).groupBy(
        "quantum_threat_type", "classical_security_status", "quantum_security_status"
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if("quantum_vulnerable").alias("vulnerable"))


@check("score_risk", A.with_ctes(*_S, select="SELECT asset_id, risk_score, risk_severity AS severity FROM scored"))
def _(spark, sf):
    return risk.score_risk(classified(spark, sf), explain=False)


@check("risk_factors", A.with_ctes(*_S, """
factor AS (
  SELECT asset_id, unnest([
    CASE branch WHEN 'none' THEN {'n':'operational_context','s':0.0,'f':'primitive_type'}
      WHEN 'broken' THEN {'n':'classical_vulnerability','s':100.0,'f':'classical_security_status'}
      WHEN 'pqc' THEN {'n':'quantum_vulnerability','s':0.0,'f':'quantum_threat_type'}
      WHEN 'shor' THEN {'n':'quantum_vulnerability','s':90.0,'f':'quantum_threat_type'}
      WHEN '3des' THEN {'n':'quantum_vulnerability','s':60.0,'f':'quantum_threat_type'}
      WHEN '256' THEN {'n':'quantum_vulnerability','s':20.0,'f':'quantum_security_status'}
      WHEN '128' THEN {'n':'quantum_vulnerability','s':60.0,'f':'quantum_threat_type'}
      WHEN '192' THEN {'n':'quantum_vulnerability','s':60.0,'f':'quantum_threat_type'}
      WHEN 'open' THEN {'n':'quantum_vulnerability','s':45.0,'f':'quantum_threat_type'}
      WHEN 'hlong' THEN {'n':'quantum_vulnerability','s':15.0,'f':'quantum_security_status'}
      WHEN 'h256' THEN {'n':'quantum_vulnerability','s':40.0,'f':'quantum_security_status'}
      WHEN 'h224' THEN {'n':'quantum_vulnerability','s':55.0,'f':'quantum_security_status'}
      WHEN 'kbroken' THEN {'n':'classical_vulnerability','s':100.0,'f':'classical_security_status'}
      WHEN 'keyed' THEN {'n':'quantum_vulnerability','s':30.0,'f':'quantum_security_status'}
      WHEN 'proto' THEN {'n':'quantum_vulnerability','s':25.0,'f':'quantum_security_status'}
      ELSE {'n':'uncertainty_baseline','s':50.0,'f':'algorithm'} END,
    CASE branch WHEN 'broken' THEN {'n':'quantum_vulnerability','s':0.0,'f':'quantum_threat_type'}
      WHEN '3des' THEN {'n':'classical_vulnerability','s':15.0,'f':'classical_security_status'}
      WHEN '256' THEN {'n':'parameter_key_length','s':-10.0,'f':'key_length_bits'}
      WHEN '128' THEN {'n':'parameter_key_length','s':10.0,'f':'key_length_bits'}
      WHEN '192' THEN {'n':'parameter_key_length','s':-5.0,'f':'key_length_bits'}
      WHEN 'open' THEN {'n':'parameter_uncertainty','s':5.0,'f':'key_length_bits'}
      WHEN 'h224' THEN {'n':'classical_vulnerability','s':10.0,'f':'classical_security_status'} END,
    CASE WHEN branch = 'shor' AND ua LIKE '%RSA%' AND key_length_bits < 2048 THEN {'n':'parameter_key_length','s':10.0,'f':'key_length_bits'}
      WHEN branch = 'shor' AND ua LIKE '%RSA%' AND key_length_bits >= 4096 THEN {'n':'parameter_key_length','s':-5.0,'f':'key_length_bits'}
      WHEN branch = 'shor' AND ua LIKE '%RSA%' AND key_length_bits IS NULL THEN {'n':'parameter_key_length','s':0.0,'f':'key_length_bits'}
      WHEN branch = 'shor' AND ua NOT LIKE '%RSA%' AND fam = 'ECC' AND curve IS NULL THEN {'n':'parameter_curve','s':0.0,'f':'curve'} END,
    CASE WHEN branch = 'shor' AND upper(padding) LIKE '%PKCS1%' THEN {'n':'parameter_padding','s':5.0,'f':'padding'} END,
    CASE WHEN branch IN ('256','128','open') AND upper(mode) = 'ECB' THEN {'n':'parameter_cipher_mode','s':15.0,'f':'mode'} END
  ]) AS f FROM scored)
""", select="""
SELECT f.n AS name, f.s AS score, f.f AS source_field, count(*) AS n, count(DISTINCT asset_id) AS assets
FROM factor WHERE f IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    rows = risk.risk_factors(risk.score_risk(classified(spark, sf)))
    return rows.groupBy("name", F.col("score").cast("double").alias("score"), "source_field").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("asset_id").alias("assets"))


_REPORT = """
SELECT round(0.7 * max(risk_score) + 0.3 * avg(risk_score), 1) AS overall_risk_score,
  count(*) AS total_assets_discovered,
  count(*) FILTER (WHERE risk_score >= 60 OR quantum_vulnerable IS TRUE OR classical_security_status = 'BROKEN') AS vulnerable_assets_count,
  count(*) FILTER (WHERE quantum_threat_type = 'SHOR_POLYNOMIAL_BREAK') AS shor_vulnerable_count,
  count(*) FILTER (WHERE quantum_threat_type = 'GROVER_BIT_HALVING' AND quantum_vulnerable IS TRUE) AS grover_impacted_count,
  count(*) FILTER (WHERE classical_security_status = 'BROKEN' OR quantum_threat_type = 'CLASSICALLY_BROKEN') AS classically_broken_count,
  count(*) FILTER (WHERE quantum_threat_type = 'QUANTUM_RESISTANT' OR (quantum_vulnerable IS FALSE AND classical_security_status = 'SECURE')) AS quantum_resistant_count,
  count(*) FILTER (WHERE risk_severity = 'CRITICAL') AS severity_critical, count(*) FILTER (WHERE risk_severity = 'HIGH') AS severity_high,
  count(*) FILTER (WHERE risk_severity = 'MEDIUM') AS severity_medium, count(*) FILTER (WHERE risk_severity = 'LOW') AS severity_low
FROM scored"""


@check("risk_report", A.with_ctes(*_S, select=f"""
SELECT *, CASE WHEN overall_risk_score >= 80 THEN 'CRITICAL' WHEN overall_risk_score >= 60 THEN 'HIGH'
  WHEN overall_risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS overall_severity FROM ({_REPORT}) r"""))
def _(spark, sf):
    return risk.risk_report(scored(spark, sf))


@check("empty_risk_report", A.with_ctes(*_S, select="""
SELECT 0.0::DOUBLE AS overall_risk_score, 'LOW' AS overall_severity, count(*) AS total_assets_discovered
FROM scored WHERE algorithm = 'no such algorithm'"""))
def _(spark, sf):
    none = scored(spark, sf).where(F.col("algorithm") == "no such algorithm")
    return risk.risk_report(none).select("overall_risk_score", "overall_severity", "total_assets_discovered")


@check("severity_distribution", A.with_ctes(*_S, select="""
SELECT t.severity, count(s.asset_id) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) AS t(severity)
LEFT JOIN scored s ON s.risk_severity = t.severity GROUP BY 1"""))
def _(spark, sf):
    return reports.severity_distribution(scored(spark, sf), "risk_severity")


@check("threat_rows", A.with_ctes(*_S, f"report AS ({_REPORT})", select="""
SELECT 0 AS position, 'shor' AS kind, shor_vulnerable_count AS n FROM report
UNION ALL SELECT 1, 'grover', grover_impacted_count FROM report
UNION ALL SELECT 2, 'broken', classically_broken_count FROM report
UNION ALL SELECT 3, 'resistant', quantum_resistant_count FROM report"""))
def _(spark, sf):
    return reports.threat_rows(risk.risk_report(scored(spark, sf)))


# --- timeline ---------------------------------------------------------------

_TIMED_COLUMNS = [
    "asset_id", "x_data_lifetime_years", "y_migration_time_years", "z_quantum_arrival_years", "x_plus_y",
    "inequality_triggered", "exposure_gap_years", "urgency", "hndl_exposure", "migration_deadline_years", "applicable",
]


@check("assess_timeline", A.with_ctes(*_T, select="""
SELECT asset_id, CASE WHEN applicable THEN x END AS x_data_lifetime_years, CASE WHEN applicable THEN y END AS y_migration_time_years,
  CASE WHEN applicable THEN z END AS z_quantum_arrival_years, x_plus_y, inequality_triggered, exposure_gap_years, urgency,
  hndl_exposure, migration_deadline_years, applicable FROM timed"""))
def _(spark, sf):
    return timed(spark, sf).select(*_TIMED_COLUMNS)


@check("timeline_without_defaults", A.with_ctes(*_C, """
timing AS (SELECT asset_id, algorithm, primitive_type, quantum_vulnerable, quantum_threat_type, CAST(NULL AS DOUBLE) AS x,
  CAST(NULL AS DOUBLE) AS y_given, 15.0 AS z, CAST(NULL AS BOOLEAN) AS hndl_sensitive FROM classified)""",
    A.TIMED_FROM_TIMING, select="SELECT urgency, hndl_exposure, applicable, count(*) AS n FROM timed GROUP BY ALL"))
def _(spark, sf):
    config = timeline.TimelineConfig(quantum_arrival_years=15.0)
    return timeline.assess_timeline(classified(spark, sf), None, config).groupBy(
        "urgency", "hndl_exposure", "applicable").agg(F.count(F.lit(1)).alias("n"))


_DIST = ["immediate", "urgent", "planned", "monitor", "unknown", "not_required"]
_EXPO = ["critical", "high", "medium", "low", "none", "unknown"]


@check("timeline_report", A.with_ctes(*_T, select="SELECT count(*) AS total_assets, count(*) FILTER (WHERE applicable) AS applicable_assets, "
    "count(*) FILTER (WHERE inequality_triggered IS TRUE) AS triggered_assets, "
    "count(*) FILTER (WHERE hndl_exposure NOT IN ('NONE','UNKNOWN')) AS exposed_assets, "
    + ", ".join(f"count(*) FILTER (WHERE urgency = '{u.upper()}') AS urgency_{u}" for u in _DIST) + ", "
    + ", ".join(f"count(*) FILTER (WHERE hndl_exposure = '{e.upper()}') AS hndl_{e}" for e in _EXPO) + " FROM timed"))
def _(spark, sf):
    return timeline.timeline_report(timed(spark, sf))


@check("highest_urgency", A.with_ctes(*_T, select="""
SELECT asset_id, urgency, hndl_exposure, inequality_triggered, applicable FROM (
  SELECT * FROM timed ORDER BY CASE urgency WHEN 'IMMEDIATE' THEN 0 WHEN 'URGENT' THEN 1 WHEN 'PLANNED' THEN 2 WHEN 'MONITOR' THEN 3
    WHEN 'UNKNOWN' THEN 4 ELSE 5 END, asset_id LIMIT 10) t WHERE urgency <> 'NOT_REQUIRED'"""))
def _(spark, sf):
    return timeline.highest_urgency(timed(spark, sf))


@check("invalid_durations", A.with_ctes(A.FACTS, """
odd AS (SELECT asset_id, CASE WHEN start_line % 5 = 0 THEN -x_years WHEN start_line % 5 = 1 THEN 'NaN'::DOUBLE ELSE x_years END AS x,
  CASE WHEN start_line % 7 = 0 THEN 'Infinity'::DOUBLE ELSE y_years END AS y FROM facts)""", select="""
SELECT asset_id, field, problem FROM (
  SELECT asset_id, 'protected_lifetime_years' AS field, CASE WHEN isnan(x) THEN 'not a number' WHEN isinf(x) THEN 'infinite' WHEN x < 0 THEN 'negative' END AS problem FROM odd
  UNION ALL SELECT asset_id, 'migration_time_years', CASE WHEN isnan(y) THEN 'not a number' WHEN isinf(y) THEN 'infinite' WHEN y < 0 THEN 'negative' END FROM odd) q
WHERE problem IS NOT NULL"""))
def _(spark, sf):
    odd = asset_facts(spark, sf).selectExpr(
        "asset_id",
        "CASE WHEN start_line % 5 = 0 THEN -x_years WHEN start_line % 5 = 1 THEN double('NaN') ELSE x_years END AS protected_lifetime_years",
        "CASE WHEN start_line % 7 = 0 THEN double('Infinity') ELSE y_years END AS migration_time_years",
        "CAST(NULL AS DOUBLE) AS quantum_arrival_years")
    return timeline.invalid_durations(odd).select("asset_id", "field", "problem")


@check("scenario_grid", A.with_ctes(*_C, f"""
timing AS (SELECT asset_id, algorithm, primitive_type, quantum_vulnerable, quantum_threat_type, xs.x, CAST(NULL AS DOUBLE) AS y_given,
  zs.z, CAST(NULL AS BOOLEAN) AS hndl_sensitive FROM classified, (SELECT unnest({[float(x) for x in XS]}) AS x) xs, (SELECT unnest({[float(z) for z in ZS]}) AS z) zs)""",
    A.TIMED_FROM_TIMING, select="""
SELECT CAST(x AS DOUBLE) AS scenario_x, CAST(z AS DOUBLE) AS scenario_z, urgency, hndl_exposure, count(*) AS n FROM timed GROUP BY ALL"""))
def _(spark, sf):
    return timeline.scenario_grid(classified(spark, sf), XS, ZS).groupBy(
        "scenario_x", "scenario_z", "urgency", "hndl_exposure").agg(F.count(F.lit(1)).alias("n"))


@check("scenario_index", A.with_ctes(*_C, f"""
timing AS (SELECT asset_id, algorithm, primitive_type, quantum_vulnerable, quantum_threat_type, xs.x, CAST(NULL AS DOUBLE) AS y_given,
  zs.z, CAST(NULL AS BOOLEAN) AS hndl_sensitive FROM classified, (SELECT unnest({[float(x) for x in XS]}) AS x) xs, (SELECT unnest({[float(z) for z in ZS]}) AS z) zs)""",
    A.TIMED_FROM_TIMING, select="""
SELECT CAST(x AS DOUBLE) AS scenario_x, CAST(z AS DOUBLE) AS scenario_z, count(*) FILTER (WHERE inequality_triggered) AS triggered FROM timed GROUP BY 1, 2"""))
def _(spark, sf):
    return timeline.scenario_index(asset_facts(spark, sf), XS, ZS)


_SCENARIOS = f"""(SELECT unnest({[float(x) for x in XS]}) AS x) xs, (SELECT unnest({[float(z) for z in ZS]}) AS z) zs"""


@check("scenario_ranks", A.with_ctes(*_C, f"""
timing AS (SELECT asset_id, algorithm, primitive_type, quantum_vulnerable, quantum_threat_type, xs.x, y_years AS y_given, zs.z, hndl_sensitive FROM classified, {_SCENARIOS})""",
    A.TIMED_FROM_TIMING, select="""
SELECT CAST(x AS DOUBLE) AS scenario_x, CAST(z AS DOUBLE) AS scenario_z, urgency, hndl_exposure, count(*) AS n FROM timed GROUP BY ALL"""))
def _(spark, sf):
    ranks = timeline.scenario_ranks(classified(spark, sf), timeline_inputs(asset_facts(spark, sf)))
    return timeline.scenario_counts(ranks, XS, ZS)


# --- recommendations --------------------------------------------------------


@check("recommend", A.with_ctes(*_R, select="SELECT * FROM advised"))
def _(spark, sf):
    return advised(spark, sf)


_TYPES = ["direct_pqc", "classical_upgrade", "hybrid", "already_pqc", "no_migration_required", "unknown"]
_REC_REPORT = "SELECT count(*) AS total_assets, " + ", ".join(
    f"count(*) FILTER (WHERE recommendation_type = '{t.upper()}') AS {t}_count" for t in _TYPES) + " FROM advised"


@check("recommendation_report", A.with_ctes(*_R, select=_REC_REPORT))
def _(spark, sf):
    return recommend.recommendation_report(advised(spark, sf))


@check("recommendation_distributions", A.with_ctes(*_R, select="""
SELECT 'recommended_algorithm' AS dimension, recommended_algorithm AS value, count(*) AS n FROM advised WHERE recommended_algorithm IS NOT NULL GROUP BY 2
UNION ALL SELECT 'current_algorithm', current_algorithm, count(*) FROM advised GROUP BY 2
UNION ALL SELECT 'current_primitive', current_primitive, count(*) FROM advised GROUP BY 2"""))
def _(spark, sf):
    return recommend.recommendation_distributions(advised(spark, sf))


@check("type_rows", A.with_ctes(*_R, f"report AS ({_REC_REPORT})", select=" UNION ALL ".join(
    f"SELECT {i} AS position, '{t.upper()}' AS kind, {t}_count AS n FROM report" for i, t in enumerate(_TYPES))))
def _(spark, sf):
    return reports.type_rows(recommend.recommendation_report(advised(spark, sf)))


@check("recommendation_detail", A.with_ctes(*_R, select="""
SELECT asset_id, current_algorithm, recommendation_type, recommended_algorithm, pqc_standard, hybrid_recommendation,
  migration_complexity, confidence FROM advised"""))
def _(spark, sf):
    return listing.recommendation_detail(advised(spark, sf))


# --- joined views -----------------------------------------------------------


@check("asset_index", A.with_ctes(*_S, A.TIMED, A.ADVISED, select="""
SELECT s.asset_id, s.algorithm, s.risk_score, s.risk_severity, t.urgency, t.hndl_exposure, t.exposure_gap_years, r.recommendation_type, r.recommended_algorithm
FROM scored s LEFT JOIN timed t USING (asset_id) LEFT JOIN advised r USING (asset_id)"""))
def _(spark, sf):
    return reports.asset_index(scored(spark, sf), timed(spark, sf), advised(spark, sf)).select(
        "asset_id", "algorithm", "risk_score", "risk_severity", "urgency", "hndl_exposure", "exposure_gap_years",
        "recommendation_type", "recommended_algorithm")


@check("immediate_items", A.with_ctes(*_S, A.TIMED, A.ADVISED, select="""
SELECT s.asset_id, s.algorithm, s.risk_score, r.recommended_algorithm
FROM scored s JOIN timed t USING (asset_id) LEFT JOIN advised r USING (asset_id) WHERE t.urgency = 'IMMEDIATE'"""))
def _(spark, sf):
    index = reports.asset_index(scored(spark, sf), timed(spark, sf), advised(spark, sf))
    return reports.immediate_items(index).select("asset_id", "algorithm", "risk_score", "recommended_algorithm")


@check("inventory_export", A.with_ctes(*_S, A.TIMED, A.ADVISED, select="""
SELECT r.asset_id, r.current_algorithm AS algorithm, r.current_primitive AS primitive_type, s.risk_score, s.risk_severity, t.urgency, t.hndl_exposure,
  t.x_plus_y AS x_plus_y_years, CASE WHEN t.applicable THEN t.z END AS z_years, t.exposure_gap_years, r.recommendation_type, r.recommended_algorithm,
  r.pqc_standard, r.hybrid_recommendation AS hybrid_scheme, r.migration_complexity
FROM advised r LEFT JOIN scored s USING (asset_id) LEFT JOIN timed t USING (asset_id)"""))
def _(spark, sf):
    out = reports.inventory_export(advised(spark, sf), risk.score_risk(classified(spark, sf)), timed(spark, sf))
    return out.drop("risk_rationale")


@check("asset_dossier", A.with_ctes(*_S, A.TIMED, A.ADVISED, select="""
SELECT s.asset_id, s.algorithm, s.risk_score, t.urgency, r.recommendation_type FROM scored s JOIN timed t USING (asset_id)
JOIN advised r USING (asset_id) WHERE s.asset_id = (SELECT min(asset_id) FROM facts)"""))
def _(spark, sf):
    index = reports.asset_index(scored(spark, sf), timed(spark, sf), advised(spark, sf))
    first = asset_facts(spark, sf).agg(F.min("asset_id")).first()[0]
    return reports.asset_dossier(index, first).select("asset_id", "algorithm", "risk_score", "urgency", "recommendation_type")


@check("migration_buckets", A.with_ctes(*_S, A.TIMED, select="""
SELECT urgency, asset_id, risk_score, position, bucket_rank FROM (
  SELECT t.urgency, s.asset_id, s.risk_score, CAST(row_number() OVER (PARTITION BY t.urgency ORDER BY s.risk_score DESC, s.asset_id) AS INT) AS position,
    CASE t.urgency WHEN 'IMMEDIATE' THEN 0 WHEN 'URGENT' THEN 1 WHEN 'PLANNED' THEN 2 WHEN 'MONITOR' THEN 3 WHEN 'UNKNOWN' THEN 4 ELSE 5 END AS bucket_rank
  FROM scored s JOIN timed t USING (asset_id)) q WHERE position <= 5"""))
def _(spark, sf):
    joined = scored(spark, sf).join(timed(spark, sf).select("asset_id", "urgency"), "asset_id")
    return listing.migration_buckets(joined).select("urgency", "asset_id", "risk_score", "position", "bucket_rank")


@check("bucket_sizes", A.with_ctes(*_R, select="SELECT recommendation_type, count(*) AS n FROM advised GROUP BY 1"))
def _(spark, sf):
    return listing.bucket_sizes(advised(spark, sf), "recommendation_type").drop("bucket_rank")


# --- listing ----------------------------------------------------------------


@check("filter_assets", A.with_ctes(*_S, select="""
SELECT asset_id, algorithm, risk_score FROM scored WHERE primitive_type = 'SYMMETRIC_CIPHER' AND quantum_vulnerable = TRUE
  AND quantum_threat_type = 'GROVER_BIT_HALVING' AND risk_severity = 'HIGH' AND implementation_library = 'OpenSSL'"""))
def _(spark, sf):
    return listing.filter_assets(
        scored(spark, sf), primitive_type="SYMMETRIC_CIPHER", quantum_vulnerable=True,
        quantum_threat_type="GROVER_BIT_HALVING", severity="HIGH", library="OpenSSL",
    ).select("asset_id", "algorithm", "risk_score")


@check("search_assets", A.with_ctes(A.FACTS, select="""
SELECT asset_id FROM facts WHERE contains(lower(coalesce(algorithm,'') || ' ' || coalesce(implementation_library,'')), 'rsa openssl')
  OR contains(lower(file_path), 'rsa openssl') OR contains(lower(file_path), 'src3/mod7.')"""))
def _(spark, sf):
    facts = asset_facts(spark, sf)
    fields = ["algorithm", "implementation_library"]
    both = listing.search(facts, " RSA OpenSSL ", fields, "file_path").unionByName(
        listing.search(facts, "SRC3/mod7.", fields, "file_path"))
    return both.select("asset_id").distinct()


@check("page_descending", A.with_ctes(A.FACTS, select="""
SELECT asset_id, key_length_bits FROM facts ORDER BY key_length_bits DESC NULLS FIRST, asset_id LIMIT 50 OFFSET 100"""))
def _(spark, sf):
    return listing.paginate(asset_facts(spark, sf), "key_length_bits", "desc", ["asset_id"], page=3).select("asset_id", "key_length_bits")


@check("page_ascending", A.with_ctes(A.FACTS, select="""
SELECT asset_id, key_length_bits FROM facts ORDER BY key_length_bits ASC NULLS LAST, asset_id LIMIT 20"""))
def _(spark, sf):
    return listing.paginate(asset_facts(spark, sf), "key_length_bits", "asc", ["asset_id"], page_size=20).select("asset_id", "key_length_bits")


@check("page_after", A.with_ctes(*_S, select="""
SELECT asset_id, risk_score FROM scored WHERE risk_score < 75 OR (risk_score = 75 AND asset_id > '5') ORDER BY risk_score DESC NULLS FIRST, asset_id LIMIT 50"""))
def _(spark, sf):
    return listing.page_after(scored(spark, sf), "risk_score", "desc", "asset_id", 75, "5").select("asset_id", "risk_score")


@check("page_info", A.with_ctes(A.FACTS, select="""
SELECT 2 AS page, 50 AS page_size, count(*) AS total_items, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS total_pages FROM facts"""))
def _(spark, sf):
    return listing.page_info(asset_facts(spark, sf), 2, 50)


@check("top_assets", A.with_ctes(*_S, select="SELECT asset_id, risk_score FROM scored ORDER BY risk_score DESC NULLS FIRST, asset_id LIMIT 5"))
def _(spark, sf):
    return listing.top_assets(scored(spark, sf)).select("asset_id", "risk_score")


@check("canonical_order", A.with_ctes(A.FACTS, select="""
SELECT asset_id FROM facts ORDER BY file_path, coalesce(start_line, 0), algorithm, asset_id LIMIT 100"""))
def _(spark, sf):
    from keystrata.operators.merge import canonical_order

    return canonical_order(with_location(asset_facts(spark, sf))).limit(100).select("asset_id")


@check("asset_by_id", A.with_ctes(A.FACTS, select="SELECT asset_id, algorithm, curve FROM facts WHERE asset_id = (SELECT max(asset_id) FROM facts)"))
def _(spark, sf):
    facts = asset_facts(spark, sf)
    return listing.by_id(facts, "asset_id", facts.agg(F.max("asset_id")).first()[0]).select("asset_id", "algorithm", "curve")


@check("asset_view", A.with_ctes(*_S, select="""
SELECT asset_id, algorithm, algorithm_family, primitive_type, key_length_bits, curve, mode, padding, implementation_library, file_path, start_line,
  quantum_vulnerable, quantum_threat_type, classical_security_status, quantum_security_status, effective_classical_security_bits,
  effective_quantum_security_bits, risk_score, risk_severity, round(confidence_score, 4) AS confidence_score FROM scored"""))
def _(spark, sf):
    view = listing.asset_view(risk.with_risk(classify(with_location(asset_facts(spark, sf)), notes=False)))
    return view.select("*", "location.file_path", "location.start_line").drop("location")


@check("by_component", A.with_ctes(*_S, """
cut AS (SELECT risk_severity, list_filter(string_split(file_path, '/'), lambda x: x <> '') AS parts FROM scored)""", select="""
SELECT CASE WHEN len(parts) > 1 THEN parts[1] ELSE '(root)' END AS component, count(*) AS total,
  count(*) FILTER (WHERE risk_severity = 'CRITICAL') AS critical FROM cut GROUP BY 1"""))
def _(spark, sf):
    return reports.by_component(scored(spark, sf), "file_path")


@check("facets", A.with_ctes(A.FACTS, select="""
SELECT implementation_library AS value, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM facts) AS share
FROM facts WHERE implementation_library IS NOT NULL AND implementation_library <> 'hashlib' GROUP BY 1"""))
def _(spark, sf):
    facts = asset_facts(spark, sf)
    counts = reports.facets(facts, "implementation_library", ["hashlib"])
    return reports.with_share(counts, facts.agg(F.count(F.lit(1)).alias("total")))


@check("asset_distributions", A.with_ctes(A.FACTS, """
leveled AS (SELECT *, CASE WHEN confidence_score >= 0.85 THEN 'VERY_HIGH' WHEN confidence_score >= 0.70 THEN 'HIGH' WHEN confidence_score >= 0.45 THEN 'MEDIUM'
  WHEN confidence_score >= 0.20 THEN 'LOW' ELSE 'VERY_LOW' END AS level FROM facts)""", select="""
SELECT 'algorithm' AS dimension, algorithm AS value, count(*) AS n FROM leveled GROUP BY 2
UNION ALL SELECT 'primitive_type', primitive_type, count(*) FROM leveled GROUP BY 2
UNION ALL SELECT 'implementation_library', coalesce(implementation_library, 'Unspecified'), count(*) FROM leveled GROUP BY 2
UNION ALL SELECT 'confidence_level', level, count(*) FROM leveled GROUP BY 2"""))
def _(spark, sf):
    from keystrata.functions.scoring import confidence_level

    facts = asset_facts(spark, sf)
    return reports.asset_distributions(facts.withColumn("confidence_level", confidence_level(F.col("confidence_score"))))


# --- components -------------------------------------------------------------

_COMPONENTS = """
named AS (SELECT *,
  CASE WHEN primitive_type = 'CERTIFICATE' THEN 'certificate' WHEN primitive_type = 'PROTOCOL' THEN 'protocol'
    WHEN primitive_type IN ('KEY_MATERIAL','LIBRARY') THEN 'related-crypto-material' ELSE 'algorithm' END AS asset_type,
  CASE WHEN primitive_type = 'SYMMETRIC_CIPHER' THEN algorithm || coalesce('-' || key_length_bits, '') || coalesce('-' || upper(mode), '')
    WHEN primitive_type IN ('ASYMMETRIC_ENCRYPTION','KEY_EXCHANGE') THEN algorithm || coalesce('-' || key_length_bits, '-' || curve, '')
    WHEN primitive_type = 'DIGITAL_SIGNATURE' AND fam = 'ECC' THEN algorithm || coalesce('-' || curve, '')
    WHEN primitive_type = 'DIGITAL_SIGNATURE' THEN algorithm || coalesce('-' || key_length_bits, '') ELSE algorithm END AS name,
  CASE WHEN algorithm = 'ML-KEM' THEN 'kem' WHEN grp = 'pqc' THEN 'post-quantum'
    WHEN primitive_type = 'SYMMETRIC_CIPHER' THEN CASE WHEN algorithm IN ('ChaCha20','RC4') THEN 'stream-cipher' WHEN mode = 'GCM' THEN 'ae' ELSE 'block-cipher' END
    WHEN primitive_type = 'ASYMMETRIC_ENCRYPTION' THEN 'public-key-encryption' WHEN primitive_type = 'DIGITAL_SIGNATURE' THEN 'signature'
    WHEN primitive_type = 'KEY_EXCHANGE' THEN 'key-agree' WHEN primitive_type = 'HASH_FUNCTION' THEN 'hash' WHEN primitive_type = 'MAC' THEN 'mac'
    WHEN primitive_type = 'KDF' THEN 'kdf' WHEN primitive_type = 'RANDOM' THEN 'drbg' ELSE 'unknown' END AS prim,
  CASE WHEN effective_quantum_security_bits >= 256 THEN 5 WHEN effective_quantum_security_bits >= 192 THEN 3 WHEN effective_quantum_security_bits >= 128 THEN 1 END AS qlevel
  FROM classified),
component AS (SELECT 'cryptographic-asset' AS type, asset_id AS bom_ref, name, asset_type,
  CASE WHEN asset_type = 'algorithm' THEN prim END AS primitive,
  CASE WHEN asset_type = 'algorithm' THEN coalesce(CAST(key_length_bits AS VARCHAR), curve) END AS parameter_set_identifier,
  CASE WHEN asset_type = 'algorithm' THEN curve END AS curve, CASE WHEN asset_type = 'algorithm' THEN lower(mode) END AS mode,
  CASE WHEN asset_type = 'algorithm' THEN padding END AS padding,
  CASE WHEN asset_type = 'algorithm' THEN effective_classical_security_bits END AS classical_security_level,
  CASE WHEN asset_type = 'algorithm' THEN qlevel END AS nist_quantum_security_level, quantum_threat_type FROM named)
"""


def component_table(spark, sf, notes=True):
    return components.to_components(classify(_leveled(with_location(asset_facts(spark, sf)))))


def _leveled(df):
    from keystrata.functions.scoring import confidence_level

    return df.withColumn("confidence_level", confidence_level(F.col("confidence_score")))


@check("to_components", A.with_ctes(*_C, _COMPONENTS, select="SELECT * EXCLUDE (quantum_threat_type) FROM component"))
def _(spark, sf):
    return components.component_rows(component_table(spark, sf))


@check("component_properties", A.with_ctes(*_C, select="""
SELECT name, value, count(*) AS n FROM (
  SELECT 'keystrata:classical-security-status' AS name, classical_security_status AS value FROM classified
  UNION ALL SELECT 'keystrata:effective-classical-security-bits', CAST(effective_classical_security_bits AS VARCHAR) FROM classified
  UNION ALL SELECT 'keystrata:effective-quantum-security-bits', CAST(effective_quantum_security_bits AS VARCHAR) FROM classified
  UNION ALL SELECT 'keystrata:implementation-library', implementation_library FROM classified
  UNION ALL SELECT 'keystrata:quantum-security-status', quantum_security_status FROM classified
  UNION ALL SELECT 'keystrata:quantum-threat-type', quantum_threat_type FROM classified
  UNION ALL SELECT 'keystrata:quantum-vulnerable', CAST(quantum_vulnerable AS VARCHAR) FROM classified) p
WHERE value IS NOT NULL GROUP BY 1, 2"""))
def _(spark, sf):
    free_text = ["asset-id", "confidence", "confidence-level", "classification-notes"]
    rows = component_table(spark, sf).select(F.explode("properties").alias("p")).select("p.name", "p.value")
    return rows.where(~F.col("name").isin([f"keystrata:{n}" for n in free_text])).groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("n"))


@check("component_summary", A.with_ctes(*_C, _COMPONENTS, select="""
SELECT 'asset_type' AS dimension, asset_type AS value, count(*) AS n FROM component GROUP BY 2
UNION ALL SELECT 'threat', coalesce(quantum_threat_type, 'UNKNOWN'), count(*) FROM component GROUP BY 2
UNION ALL SELECT 'total', 'components', count(*) FROM component"""))
def _(spark, sf):
    return components.component_summary(component_table(spark, sf))


@check("filter_components", A.with_ctes(*_C, _COMPONENTS, select="""
SELECT bom_ref, name FROM component WHERE asset_type = 'algorithm' AND quantum_threat_type = 'SHOR_POLYNOMIAL_BREAK'
  AND contains(lower(name || ' ' || bom_ref || ' ' || primitive), 'dsa-secp384r1')"""))
def _(spark, sf):
    return listing.filter_components(
        component_table(spark, sf), "algorithm", "SHOR_POLYNOMIAL_BREAK", "DSA-secp384r1").select("bom_ref", "name")


def damaged(spark, sf) -> DataFrame:
    """Components with faults planted by position: references repeated, fields missing or wrong."""
    facts = asset_facts(spark, sf)
    base = component_table(spark, sf).join(facts.select(F.col("asset_id").alias("bom_ref"), "start_line", "curve"), "bom_ref")
    n = F.col("start_line") % 10
    ap = F.col("crypto_properties.algorithm_properties")
    return base.select(
        F.col("bom_ref").alias("position"),
        F.when(n == 1, F.lit(None)).when(n == 2, "library").otherwise(F.col("type")).alias("type"),
        F.when(n == 3, "").when(n == 4, F.concat(F.lit("shared-"), F.coalesce("curve", F.lit("none")))).otherwise(F.col("bom_ref")).alias("bom_ref"),
        F.when(n == 5, F.lit(None)).otherwise(F.col("name")).alias("name"),
        F.when(n == 6, F.lit(None)).otherwise(F.struct(
            F.when(n == 7, "gadget").otherwise(F.col("crypto_properties.asset_type")).alias("asset_type"),
            F.when(ap.isNotNull(), ap.withField("primitive", F.when(n == 8, "magic").otherwise(ap["primitive"]))
                   .withField("nist_quantum_security_level", F.when(n == 9, 7).otherwise(ap["nist_quantum_security_level"]))
                   ).alias("algorithm_properties"),
        )).alias("crypto_properties"),
    )


_DAMAGED = """
hurt AS (SELECT c.bom_ref AS position, f.start_line % 10 AS n, c.asset_type, c.classical_security_level AS cl, c.nist_quantum_security_level AS ql,
  CASE WHEN f.start_line % 10 = 3 THEN '' WHEN f.start_line % 10 = 4 THEN concat('shared-', coalesce(f.curve, 'none')) ELSE c.bom_ref END AS bom_ref
  FROM component c JOIN facts f ON f.asset_id = c.bom_ref)
"""


@check("component_problems", A.with_ctes(*_C, _COMPONENTS, _DAMAGED, select="""
SELECT bom_ref, severity, rule FROM (
  SELECT bom_ref, 'error' AS severity, 'type_missing' AS rule FROM hurt WHERE n = 1
  UNION ALL SELECT bom_ref, 'warning', 'type_unusual' FROM hurt WHERE n = 2
  UNION ALL SELECT bom_ref, 'error', 'bom_ref_empty' FROM hurt WHERE n = 3
  UNION ALL SELECT bom_ref, 'warning', 'name_missing' FROM hurt WHERE n = 5
  UNION ALL SELECT bom_ref, 'warning', 'crypto_properties_missing' FROM hurt WHERE n = 6
  UNION ALL SELECT bom_ref, 'error', 'asset_type_invalid' FROM hurt WHERE n = 7
  UNION ALL SELECT bom_ref, 'error', 'primitive_invalid' FROM hurt WHERE n = 8 AND asset_type = 'algorithm'
  UNION ALL SELECT bom_ref, 'error', 'quantum_level_range' FROM hurt WHERE n = 9 AND asset_type = 'algorithm'
  UNION ALL SELECT bom_ref, 'error', 'classical_level_range' FROM hurt WHERE n IS DISTINCT FROM 6 AND cl < 1) p"""))
def _(spark, sf):
    return quality.component_problems(damaged(spark, sf))


@check("duplicate_refs", A.with_ctes(*_C, _COMPONENTS, _DAMAGED, select="""
SELECT position, bom_ref FROM (SELECT position, bom_ref, row_number() OVER (PARTITION BY bom_ref ORDER BY position) AS rn FROM hurt) q WHERE rn > 1"""))
def _(spark, sf):
    return quality.duplicate_refs(damaged(spark, sf), "position").select("position", "bom_ref")


@check("repeated_ids", A.with_ctes(*_C, _COMPONENTS, _DAMAGED, select="SELECT bom_ref, count(*) AS n FROM hurt GROUP BY 1 HAVING count(*) > 1"))
def _(spark, sf):
    return quality.repeated_ids(damaged(spark, sf), "bom_ref")
