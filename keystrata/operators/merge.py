"""Assets from clusters, and the evidence that links assets back to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import ids
from keystrata.functions.scoring import confidence_level
from keystrata.functions.binding import bind
from keystrata.operators import cluster

_CLUSTER = ["path_key", "leader_seq", "leader_id"]


def _first(value: str) -> Column:
    """First non-null value in emission order, over profiles that each hold one value."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col("first_key")))


def merge_clusters(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """One asset per cluster.

    The longest algorithm name wins (first among equals); every other attribute is the
    first one known in emission order. The location is that of the first parsed call with
    a line and a snippet, else of the best-scored finding with a line, else of the
    best-scored finding. Scores add a twentieth of every further score to the best one.

    Evidence stays a table of its own (``asset_evidence``) rather than a list inside the
    asset row, since one cluster may hold any share of all findings.
    """
    df = profiles.join(clusters, ["path_key", "profile_id"])
    named = F.col("algorithm") != "Unknown Algorithm"
    known = F.col("primitive_type") != "UNKNOWN"
    grouped = df.groupBy(*_CLUSTER).agg(
        F.min(F.when(named, F.struct(
            (-F.length("algorithm")).alias("rank"), F.col("first_key").alias("key"), F.col("algorithm").alias("value")
        ))).alias("_algorithm"),
        F.min(F.when(known, F.struct(F.col("first_key").alias("key"), F.col("primitive_type").alias("value")))).alias(
            "_primitive"
        ),
        *[
            _first(c).alias(c)
            for c in ["algorithm_family", "key_length_bits", "curve", "mode", "padding", "implementation_library"]
        ],
        F.sum("n").alias("finding_count"),
        F.sum("score_sum").alias("_score_sum"),
        F.bit_or("method_bits").alias("_bits"),
        F.min("anchor").alias("_anchor"),
        F.min("primary").alias("_primary"),
        F.min("container_first")["value"].alias("container_context"),
        F.min("binary_first")["value"].alias("binary_format"),
    )
    best = -F.col("_anchor.rank")
    rest = 0.05 * (F.col("_score_sum") - best)
    alone = F.col("finding_count") == 1
    assets = bind(
        grouped,
        algorithm=F.coalesce("_algorithm.value", F.lit("Unknown Algorithm")),
        primitive_type=F.coalesce("_primitive.value", F.lit("UNKNOWN")),
        location=F.col("_primary.location"),
        discovery_methods=cluster.method_names(F.col("_bits")),
        confidence_score=F.when(alone, F.round(best, 4)).otherwise(F.least(F.lit(1.0), F.round(best + rest, 4))),
    )
    assets = bind(
        assets,
        asset_id=ids.asset_uuid(
            F.col("path_key"), F.col("location.start_line"), F.col("algorithm"), F.col("key_length_bits"),
            F.col("mode"), F.col("curve"), F.col("implementation_library"),
        ),
        confidence_level=confidence_level(F.col("confidence_score")),
        confidence_rationale=F.when(alone, F.col("_anchor.rationale")).otherwise(
            F.format_string(
                "%d findings: best %.2f (%s) plus %.2f from the others (%s)",
                "finding_count", best, F.col("_anchor.method"), rest, F.array_join("discovery_methods", ", "),
            )
        ),
    )
    return assets.select(
        "asset_id", "algorithm", "algorithm_family", "primitive_type", "key_length_bits", "curve", "mode",
        "padding", "implementation_library", "location", "finding_count", "discovery_methods",
        "container_context", "binary_format", "confidence_score", "confidence_level", "confidence_rationale",
        *_CLUSTER,
    )


def confidence(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregated confidence per group: best score plus a twentieth of each other score,
    at most 1; with count, level and the methods seen."""
    out = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.max("confidence_score").alias("_best"),
        F.sum("confidence_score").alias("_sum"),
        F.bit_or(cluster.method_bit(F.col("discovery_method"))).alias("_bits"),
    )
    score = F.least(F.lit(1.0), F.round(F.col("_best") + 0.05 * (F.col("_sum") - F.col("_best")), 4))
    out = bind(out, confidence_score=score)
    return out.select(
        *keys, "finding_count", "confidence_score",
        confidence_level(F.col("confidence_score")).alias("confidence_level"),
        F.array_join(cluster.method_names(F.col("_bits")), ",").alias("methods"),
    )


def build_assets(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, evidence) of normalised findings; see ``merge_clusters`` and
    ``asset_evidence``."""
    found = cluster.assign_clusters(normalized)
    assets = merge_clusters(found.profiles, found.clusters)
    return assets, asset_evidence(found, assets)


def asset_evidence(found: cluster.Clustered, assets: DataFrame) -> DataFrame:
    """One row per finding with the asset it supports. Findings meet their cluster by path
    and profile, sorted by a number of both before the texts; a profile that many findings
    share is a skewed key on one side only, which adaptive execution splits."""
    membership = found.clusters.join(assets.select(*_CLUSTER, "asset_id"), _CLUSTER).select(
        cluster.profile_key().alias("_key"), "path_key", "profile_id", "asset_id"
    )
    keyed = found.profiled.withColumn("_key", cluster.profile_key())
    return keyed.join(membership, ["_key", "path_key", "profile_id"]).select(
        "asset_id", "finding_id", "emit_seq", "path_key", "scanner_name", "discovery_method", "raw_symbol",
        "symbol_name", "location", F.round("confidence_score", 4).alias("confidence_score"), "confidence_rationale",
    )


def asset_metadata(evidence: DataFrame) -> DataFrame:
    """The distinct values that describe an asset's evidence, in long form:
    (asset_id, attribute, value)."""
    values = {
        "discovery_method": F.col("discovery_method"),
        "scanner": F.col("scanner_name"),
        "raw_symbol": F.when(F.col("raw_symbol") != "", F.col("raw_symbol")),
        "symbol": F.when(F.col("symbol_name") != "", F.col("symbol_name")),
        "byte_offset": F.col("location.byte_offset").cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), v.alias("value")) for n, v in values.items()])
    return (
        evidence.select("asset_id", F.inline(pairs))
        .where(F.col("value").isNotNull())
        .dropDuplicates(["asset_id", "attribute", "value"])
    )


def one_per_id(assets: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Keeps the last row per asset_id in emission order; joins by id need unique ids."""
    order = order or ["leader_seq", "leader_id"]
    packed = F.max(F.struct(*order, F.struct(*assets.columns).alias("row")))
    return assets.groupBy("asset_id").agg(packed.alias("_last")).select("_last.row.*")


def evidence_chunks(evidence: DataFrame, size: int = 1000) -> DataFrame:
    """Evidence as nested lists: one row per asset, path and block of ``size`` findings in
    emission order, so that no list is longer than that whatever the asset holds."""
    number = F.row_number().over(Window.partitionBy("asset_id", "path_key").orderBy("emit_seq", "finding_id"))
    return (
        evidence.withColumn("chunk", F.floor((number - 1) / size))
        .groupBy("asset_id", "path_key", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct(
            "emit_seq", "finding_id", "scanner_name", "discovery_method", "raw_symbol", "location",
            "confidence_score", "confidence_rationale",
        ))).alias("supporting_findings"))
    )


def parent_asset(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """The asset each given finding supports."""
    return findings.select("finding_id").join(evidence.select("finding_id", "asset_id"), "finding_id")


def canonical_order(assets: DataFrame) -> DataFrame:
    """Assets by file, line, algorithm and id."""
    return assets.orderBy(
        F.col("location.file_path"), F.coalesce(F.col("location.start_line"), F.lit(0)), "algorithm", "asset_id"
    )
