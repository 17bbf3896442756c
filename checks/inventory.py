"""The composed stages: findings to reports in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import asset_sql as A
from checks import assets as asset_checks
from checks import findings as finding_checks
from keystrata.plans import inventory

QUERIES, SQL = {}, {}

# The assets built from clusters take the place of the derived assets.
_BUILT = f"""WITH RECURSIVE {finding_checks.NORM}, {finding_checks.FIT}, {finding_checks.ASSETS},
built AS (SELECT asset_id, algorithm, algorithm_family, primitive_type, key_length_bits, curve, mode, CAST(NULL AS VARCHAR) AS padding, implementation_library,
  file_path, CAST(start_line AS INT) AS start_line, confidence_score, confidence_level, finding_count FROM asset),
{A.CLASSIFIED.strip().replace("FROM facts", "FROM built")},
{A.SCORED.strip()}"""


def check(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return register


def analysed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return inventory.analyse(finding_checks.findings(spark, sf), x=8.0)


@check("inventory_assets", f"""{_BUILT} SELECT asset_id, algorithm, classical_security_status, quantum_threat_type, risk_score, risk_severity, finding_count, confidence_level, start_line FROM scored""")
def _(spark, sf):
    return analysed(spark, sf)["assets"].select(
        "asset_id", "algorithm", "classical_security_status", "quantum_threat_type", "risk_score", "risk_severity",
        "finding_count", "confidence_level", "location.start_line")


@check("inventory_risk_report", f"""{_BUILT} SELECT *, CASE WHEN overall_risk_score >= 80 THEN 'CRITICAL' WHEN overall_risk_score >= 60 THEN 'HIGH'
  WHEN overall_risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS overall_severity FROM ({asset_checks._REPORT}) r""")
def _(spark, sf):
    return analysed(spark, sf)["risk_report"]


@check("inventory_timeline", f"""{_BUILT},
timing AS (SELECT asset_id, algorithm, primitive_type, quantum_vulnerable, quantum_threat_type, 8.0 AS x, CAST(NULL AS DOUBLE) AS y_given, 10.0 AS z, CAST(NULL AS BOOLEAN) AS hndl_sensitive FROM classified),
{A.TIMED_FROM_TIMING.strip()}
SELECT urgency, hndl_exposure, count(*) AS n FROM timed GROUP BY 1, 2""")
def _(spark, sf):
    return analysed(spark, sf)["timeline"].groupBy("urgency", "hndl_exposure").agg(F.count(F.lit(1)).alias("n"))


@check("inventory_rows", f"""{_BUILT} SELECT asset_id, algorithm, risk_score, risk_severity, count(*) AS n FROM scored GROUP BY ALL""")
def _(spark, sf):
    return analysed(spark, sf)["inventory"].groupBy("asset_id", "algorithm", "risk_score", "risk_severity").agg(F.count(F.lit(1)).alias("n"))


@check("one_per_id", f"{_BUILT} SELECT DISTINCT asset_id FROM built")
def _(spark, sf):
    from keystrata.operators.merge import one_per_id

    return one_per_id(analysed(spark, sf)["assets"]).select("asset_id")
