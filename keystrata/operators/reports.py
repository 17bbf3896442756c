"""Aggregated reports, facets and cross-table views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.scoring import SEVERITIES, share
from keystrata.operators.cluster import method_bit, method_names


def normalization_stats(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """raw, produced and merged counts with the merge ratio, in one row."""
    raw = findings.agg(F.count(F.lit(1)).alias("raw_findings_count"))
    produced = assets.agg(F.count(F.lit(1)).alias("assets_produced_count"))
    # Two one-row aggregates side by side, combined by a union and a sum.
    both = raw.unionByName(produced, allowMissingColumns=True).agg(
        F.coalesce(F.sum("raw_findings_count"), F.lit(0)).alias("raw_findings_count"),
        F.coalesce(F.sum("assets_produced_count"), F.lit(0)).alias("assets_produced_count"),
    )
    merged = F.greatest(F.lit(0), F.col("raw_findings_count") - F.col("assets_produced_count"))
    return both.select(
        "*", merged.alias("findings_merged_count"),
        F.when(F.col("raw_findings_count") > 0, F.round(merged / F.col("raw_findings_count"), 4))
        .otherwise(0.0).alias("merge_ratio"),
    )


def distributions(df: DataFrame, columns: list[str], fill: dict[str, str] | None = None) -> DataFrame:
    """(dimension, value, n) for several columns in one aggregation over grouping sets;
    ``fill`` names the value that stands for null in a column."""
    fill = fill or {}
    filled = df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit(fill[c])).alias(c) if c in fill else F.col(c).cast("string")
        for c in columns
    ])
    out = filled.groupingSets([[c] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        here = F.col(f"_g_{c}") == 0
        dimension, value = F.when(here, c).otherwise(dimension), F.when(here, F.col(c)).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n")


def asset_distributions(assets: DataFrame) -> DataFrame:
    return distributions(
        assets, ["algorithm", "primitive_type", "implementation_library", "confidence_level"],
        {"implementation_library": "Unspecified"},
    )


def scan_stats(findings: DataFrame) -> DataFrame:
    """Findings per discovery method and per artifact category."""
    return distributions(findings, ["discovery_method", "artifact_category"])


def severity_distribution(risk: DataFrame, column: str = "severity") -> DataFrame:
    """Assets per severity, all four tiers present."""
    counted = risk.agg(*[F.count_if(F.col(column) == s).alias(s) for s in SEVERITIES])
    return counted.unpivot([], SEVERITIES, "severity", "n")


def by_component(assets: DataFrame, path: Column | str = "location.file_path") -> DataFrame:
    """Assets and critical assets per first path segment, '(root)' for bare file names."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    component = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(1))).otherwise("(root)")
    return assets.groupBy(component.alias("component")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("risk_severity") == "CRITICAL").alias("critical"),
    )


def component_order(components: DataFrame) -> DataFrame:
    return components.orderBy(F.desc("critical"), F.desc("total"), "component")


def facets(df: DataFrame, column: str, exclude: list[str] | None = None) -> DataFrame:
    """Non-empty values of a column with their counts and shares, largest first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("value").isNotNull() & (F.col("n") > 0))
    if exclude:
        counts = counts.where(~F.col("value").isin(exclude))
    return counts.orderBy(F.desc("n"), "value")


def with_share(counts: DataFrame, total: DataFrame, part: str = "n") -> DataFrame:
    """Adds each count's share of a one-row total (column ``total``), read as the query runs."""
    return counts.withColumn("share", share(F.col(part), total.select("total").scalar()))


def methods_per_target(findings: DataFrame, target: str) -> DataFrame:
    """Findings and sorted methods per scanned target, plus a grand total row (null target)."""
    return findings.rollup(F.col(target).alias("target")).agg(
        F.count(F.lit(1)).alias("findings"),
        F.bit_or(method_bit(F.col("discovery_method"))).alias("_bits"),
    ).select("target", "findings", F.array_join(method_names(F.col("_bits")), ", ").alias("methods"))


def count_rows(report: DataFrame, columns: dict[str, str], key: str = "kind") -> DataFrame:
    """The wide counts of a one-row report as (kind, n) rows with a fixed position."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias(key), F.col(c).cast("long").alias("n"))
        for i, (c, label) in enumerate(columns.items())
    ])
    return report.select(F.inline(cells))


def threat_rows(report: DataFrame) -> DataFrame:
    return count_rows(report, {
        "shor_vulnerable_count": "shor", "grover_impacted_count": "grover",
        "classically_broken_count": "broken", "quantum_resistant_count": "resistant",
    })


def type_rows(report: DataFrame) -> DataFrame:
    return count_rows(report, {
        "direct_pqc_count": "DIRECT_PQC", "classical_upgrade_count": "CLASSICAL_UPGRADE", "hybrid_count": "HYBRID",
        "already_pqc_count": "ALREADY_PQC", "no_migration_required_count": "NO_MIGRATION_REQUIRED",
        "unknown_count": "UNKNOWN",
    })


# --- views over several stages ----------------------------------------------


INDEX_TIMELINE = ("urgency", "hndl_exposure", "inequality_triggered", "exposure_gap_years", "migration_deadline_years")
INDEX_ADVICE = ("recommendation_type", "recommended_algorithm", "migration_complexity")


def asset_index(assets: DataFrame, timeline: DataFrame, recs: DataFrame) -> DataFrame:
    """Assets with their timeline and recommendation from tables of their own; ids must be
    unique there. The composed run has all of them in one row and joins nothing."""
    t = timeline.select("asset_id", *INDEX_TIMELINE)
    r = recs.select("asset_id", *INDEX_ADVICE)
    return assets.join(t, "asset_id", "left").join(r, "asset_id", "left")


def immediate_items(index: DataFrame) -> DataFrame:
    return index.where(F.col("urgency") == "IMMEDIATE")


def inventory_export(recs: DataFrame, risk: DataFrame, timeline: DataFrame) -> DataFrame:
    """The 16-column inventory: recommendations with risk and timeline."""
    r = risk.select(
        "asset_id", "risk_score", F.col("severity").alias("risk_severity"), F.col("rationale").alias("risk_rationale")
    )
    t = timeline.select(
        "asset_id", "urgency", "hndl_exposure", F.col("x_plus_y").alias("x_plus_y_years"),
        F.col("z_quantum_arrival_years").alias("z_years"), "exposure_gap_years",
    )
    out = recs.join(r, "asset_id", "left").join(t, "asset_id", "left")
    return out.select(
        "asset_id", F.col("current_algorithm").alias("algorithm"), F.col("current_primitive").alias("primitive_type"),
        "risk_score", "risk_severity", "risk_rationale", "urgency", "hndl_exposure", "x_plus_y_years", "z_years",
        "exposure_gap_years", "recommendation_type", "recommended_algorithm", "pqc_standard",
        F.col("hybrid_recommendation").alias("hybrid_scheme"), "migration_complexity",
    )


def inventory_columns() -> list[Column]:
    """The columns of ``inventory_export`` from rows with structs risk, timeline and advice."""
    return [
        F.col("advice.asset_id"), F.col("advice.current_algorithm").alias("algorithm"), F.col("advice.current_primitive").alias("primitive_type"),
        F.col("risk.risk_score"), F.col("risk.severity").alias("risk_severity"), F.col("risk.rationale").alias("risk_rationale"),
        F.col("timeline.urgency"), F.col("timeline.hndl_exposure"), F.col("timeline.x_plus_y").alias("x_plus_y_years"),
        F.col("timeline.z_quantum_arrival_years").alias("z_years"), F.col("timeline.exposure_gap_years"),
        F.col("advice.recommendation_type"), F.col("advice.recommended_algorithm"), F.col("advice.pqc_standard"),
        F.col("advice.hybrid_recommendation").alias("hybrid_scheme"), F.col("advice.migration_complexity"),
    ]


def asset_dossier(index: DataFrame, asset_id: str) -> DataFrame:
    return index.where(F.col("asset_id") == asset_id).limit(1)
