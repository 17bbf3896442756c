"""Validity rules over stage tables and component documents, as rows of problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators import components as C

_SERIAL = r"^urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _problems(df: DataFrame, keep: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per (row, violated rule): severity, rule."""
    cells = F.array(*[
        F.struct(F.lit(level).alias("severity"), F.lit(rule).alias("rule"), F.coalesce(failed, F.lit(False)).alias("failed"))
        for level, rule, failed in rules
    ])
    found = F.filter(cells, lambda c: c["failed"])
    return df.select(*keep, F.inline(found)).drop("failed")


def validate_header(header: DataFrame) -> DataFrame:
    """Problems of a document header row. Columns: bom_format, spec_version, version,
    serial_number, has_metadata, has_tools, has_components."""
    missing = lambda c: F.col(c).isNull()
    return _problems(header, [], [
        ("error", "bom_format_missing", missing("bom_format")),
        ("error", "bom_format_wrong", F.col("bom_format") != C.FORMAT),
        ("error", "spec_version_missing", missing("spec_version")),
        ("error", "spec_version_wrong", F.col("spec_version") != C.SPEC_VERSION),
        ("error", "version_missing", missing("version")),
        ("error", "version_below_one", F.col("version") < 1),
        ("error", "components_missing", ~F.col("has_components")),
        ("error", "serial_number_form", ~F.col("serial_number").rlike(_SERIAL)),
        ("warning", "metadata_missing", ~F.col("has_metadata")),
        ("warning", "tools_missing", F.col("has_metadata") & ~F.col("has_tools")),
    ])


def component_problems(components: DataFrame) -> DataFrame:
    """(bom_ref, severity, rule) for every structural problem of every component."""
    cp, ap = F.col("crypto_properties"), F.col("crypto_properties.algorithm_properties")
    has_cp, has_ap = cp.isNotNull(), ap.isNotNull()
    kind = cp["asset_type"]
    return _problems(components, ["bom_ref"], [
        ("error", "type_missing", F.col("type").isNull()),
        ("warning", "type_unusual", F.col("type") != C.COMPONENT_TYPE),
        ("error", "bom_ref_empty", F.col("bom_ref") == ""),
        ("warning", "name_missing", F.col("name").isNull()),
        ("warning", "crypto_properties_missing", ~has_cp),
        ("error", "asset_type_missing", has_cp & kind.isNull()),
        ("error", "asset_type_invalid", has_cp & ~kind.isin(C.ASSET_TYPES)),
        ("warning", "algorithm_properties_missing", has_cp & (kind == "algorithm") & ~has_ap),
        ("error", "primitive_missing", has_ap & ap["primitive"].isNull()),
        ("error", "primitive_invalid", has_ap & ~ap["primitive"].isin(C.PRIMITIVES)),
        ("warning", "environment_missing", has_ap & ap["execution_environment"].isNull()),
        ("error", "quantum_level_range", ~ap["nist_quantum_security_level"].between(1, 5)),
        ("error", "classical_level_range", ap["classical_security_level"] < 1),
    ])


def duplicate_refs(components: DataFrame, order: str) -> DataFrame:
    """Second and further occurrences of a reference, in ``order``.

    Repeated references are counted first and joined back, so a reference that many rows
    share is split like any skewed join key instead of forming one window."""
    repeated = (
        components.where(F.col("bom_ref").isNotNull())
        .groupBy("bom_ref")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    return components.join(repeated, "bom_ref").where(F.col(order) > F.col("_first")).drop("_first")


def validate_components(header: DataFrame, components: DataFrame, order: str) -> DataFrame:
    """All problems of a document: header, components and repeated references."""
    none = F.lit(None).cast("string").alias("bom_ref")
    repeats = duplicate_refs(components, order).select(
        "bom_ref", F.lit("error").alias("severity"), F.lit("bom_ref_repeated").alias("rule")
    )
    return (
        validate_header(header).select(none, "severity", "rule")
        .unionByName(component_problems(components))
        .unionByName(repeats)
    )


def validity(problems: DataFrame) -> DataFrame:
    """One row: errors, warnings, is_valid."""
    return problems.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    ).withColumn("is_valid", F.col("errors") == 0)


def finding_problems(findings: DataFrame) -> DataFrame:
    """(finding_id, severity, rule): score bounds and required fields."""
    score = F.col("confidence_score")
    return _problems(findings, ["finding_id"], [
        ("error", "confidence_missing", score.isNull() | F.isnan(score)),
        ("error", "confidence_range", (score < 0) | (score > 1)),
        ("error", "category_missing", F.col("artifact_category").isNull()),
        ("error", "path_missing", F.col("location.file_path").isNull()),
    ])


def risk_problems(risk: DataFrame) -> DataFrame:
    return _problems(risk, ["asset_id"], [
        ("error", "score_range", ~F.col("risk_score").between(0, 100)),
        ("error", "score_missing", F.col("risk_score").isNull()),
    ])


def repeated_ids(df: DataFrame, key: str = "asset_id") -> DataFrame:
    """Ids that occur more than once, with their count; must be empty before joins by id."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
