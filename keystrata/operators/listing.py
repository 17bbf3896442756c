"""Filtering, searching, sorting and paging of stage tables, and row projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.dims import policy
from keystrata.functions.scoring import confidence_level
from keystrata.functions.text import lookup
from keystrata.operators.merge import evidence_chunks
from keystrata.session import checkpointed

# --- filters ----------------------------------------------------------------


def _equal(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    for column, value in conditions.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def filter_assets(
    df: DataFrame, algorithm: str | None = None, primitive_type: str | None = None,
    quantum_vulnerable: bool | None = None, quantum_threat_type: str | None = None,
    severity: str | None = None, library: str | None = None,
) -> DataFrame:
    """Assets that equal every given value; an unknown value equals nothing."""
    return _equal(df, {
        "algorithm": algorithm, "primitive_type": primitive_type, "quantum_vulnerable": quantum_vulnerable,
        "quantum_threat_type": quantum_threat_type, "risk_severity": severity, "implementation_library": library,
    })


def filter_findings(
    df: DataFrame, algorithm: str | None = None, category: str | None = None, scanner: str | None = None,
    method: str | None = None, min_confidence: float | None = None,
) -> DataFrame:
    """Findings by equality, scanner name part (any case) and rounded minimum score."""
    df = _equal(df, {"suspected_algorithm": algorithm, "artifact_category": category, "discovery_method": method})
    if scanner:
        df = df.where(F.contains(F.lower("scanner_name"), F.lit(scanner.lower())))
    if min_confidence is not None:
        df = df.where(F.round("confidence_score", 4) >= min_confidence)
    return df


def search(df: DataFrame, query: str | None, fields: list[str], path: str | None = None) -> DataFrame:
    """Rows whose fields, joined by spaces, contain the query in any case; a hit may run
    across two fields. ``path`` is searched on its own."""
    needle = (query or "").strip().lower()
    if not needle:
        return df
    blank = F.lit("")
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), blank) for f in fields]))
    hit = F.contains(hay, F.lit(needle))
    if path:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(path), blank)), F.lit(needle))
    return df.where(hit)


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def component_threat(properties: Column) -> Column:
    """Value of the threat property of a component, UNKNOWN without one."""
    found = F.filter(properties, lambda p: p["name"] == "keystrata:quantum-threat-type")
    return F.coalesce(F.try_element_at(found, F.lit(1))["value"], F.lit("UNKNOWN"))


def filter_components(
    df: DataFrame, asset_type: str | None = None, threat: str | None = None, query: str | None = None
) -> DataFrame:
    """Components by asset type, threat and text over name, reference, primitive and first
    evidence location; fields without a value are left out of the searched text."""
    kind = F.coalesce(F.col("crypto_properties.asset_type"), F.lit("unknown"))
    if asset_type:
        df = df.where(kind == asset_type)
    if threat:
        df = df.where(component_threat(F.col("properties")) == threat)
    needle = (query or "").strip().lower()
    if needle:
        hay = F.concat_ws(
            " ", "name", "bom_ref", "crypto_properties.algorithm_properties.primitive",
            F.try_element_at("evidence", F.lit(1))["location"],
        )
        df = df.where(F.contains(F.lower(hay), F.lit(needle)))
    return df


# --- order and pages --------------------------------------------------------


def sort_columns(key: str, order: str, ties: list[str]) -> list[Column]:
    """Ascending puts nulls last and descending puts them first; ties keep ``ties`` order
    in both directions."""
    main = F.col(key).asc_nulls_last() if order == "asc" else F.col(key).desc_nulls_first()
    return [main, *[F.col(t).asc_nulls_last() for t in ties]]


def sort_rows(df: DataFrame, key: str, order: str, ties: list[str]) -> DataFrame:
    return df.orderBy(*sort_columns(key, order, ties))


def paginate(
    df: DataFrame, key: str, order: str, ties: list[str], page: int = 1, page_size: int = 50
) -> DataFrame:
    """One page of the sorted rows. Sorting and cutting form one top-k plan, in which every
    task keeps only the rows up to the page's end."""
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page counts from 1 and page_size lies in 1..200")
    return sort_rows(df, key, order, ties).offset((page - 1) * page_size).limit(page_size)


def page_after(
    df: DataFrame, key: str, order: str, unique: str, last_value: object, last_unique: object, page_size: int = 50
) -> DataFrame:
    """The page that follows a given last row. Unlike an offset, a deep page costs no more
    than the first. ``unique`` breaks ties ascending."""
    value, tie = F.col(key), F.col(unique) > F.lit(last_unique)
    if last_value is None:
        same, beyond = value.isNull(), (value.isNotNull() if order == "desc" else F.lit(False))
    else:
        same = value == F.lit(last_value)
        beyond = (value > F.lit(last_value)) | value.isNull() if order == "asc" else value < F.lit(last_value)
    return sort_rows(df.where(beyond | (same & tie)), key, order, [unique]).limit(page_size)


def page_info(df: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """page, page_size, total_items and total_pages of a listing."""
    return df.agg(F.count(F.lit(1)).alias("total_items")).select(
        F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), "total_items",
        F.greatest(F.lit(1), F.ceil(F.col("total_items") / page_size)).cast("long").alias("total_pages"),
    )


DEFAULT_SORT = {"assets": ("risk_score", "desc"), "findings": ("confidence_score", "desc"), "scans": ("created_at", "desc")}


def top_assets(df: DataFrame, n: int = 5) -> DataFrame:
    return sort_rows(df, "risk_score", "desc", ["asset_id"]).limit(n)


def bucket_previews(
    df: DataFrame, bucket: str, order: list[str], score: str = "risk_score", unique: str = "asset_id", n: int = 5
) -> DataFrame:
    """The n best rows of every bucket, with the bucket's fixed rank. The row-number limit is
    applied in every task before the shuffle, so a bucket's size does not matter."""
    w = W.partitionBy(bucket).orderBy(F.col(score).desc_nulls_last(), unique)
    rank = lookup(F.col(bucket), {b: i for i, b in enumerate(order)})
    return (
        df.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= n)
        .withColumn("bucket_rank", F.coalesce(rank, F.lit(len(order))))
    )


def migration_buckets(joined: DataFrame, group: str = "urgency", n: int = 5) -> DataFrame:
    """Previews of the migration worklist by urgency or by recommendation type."""
    order = policy.URGENCIES if group == "urgency" else policy.RECOMMENDATION_TYPES
    return bucket_previews(joined, group, order, n=n)


def bucket_sizes(joined: DataFrame, group: str = "urgency") -> DataFrame:
    """Rows per bucket in fixed order; empty buckets do not appear."""
    order = policy.URGENCIES if group == "urgency" else policy.RECOMMENDATION_TYPES
    rank = lookup(F.col(group), {b: i for i, b in enumerate(order)})
    return joined.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket_rank", rank)


# --- projections ------------------------------------------------------------


def finding_view(findings: DataFrame) -> DataFrame:
    """The listing form of a finding: score rounded, level added, nulls kept."""
    score = F.round("confidence_score", 4)
    return findings.select(
        "finding_id", "scanner_name", "scanner_version",
        F.date_format("discovered_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("discovered_at"),
        "discovery_method", "raw_symbol", "suspected_algorithm", "artifact_category", "library_hint",
        "key_size_hint", "mode_hint", "curve_hint", "location", "raw_parameters", "symbol_name",
        "binary_format", "container_context", score.alias("confidence_score"),
        confidence_level(F.col("confidence_score")).alias("confidence_level"), "confidence_rationale",
    )


def legacy_finding_view(findings: DataFrame) -> DataFrame:
    """The first format version: flat, method in lower case, a level instead of a score."""
    return findings.select(
        "finding_id",
        F.lower("discovery_method").alias("scanner_type"),
        F.col("location.file_path").alias("source_file"),
        F.col("location.start_line").alias("line_number"),
        F.col("location.end_line").alias("end_line_number"),
        "raw_symbol",
        "raw_parameters",
        F.col("location.snippet").alias("code_snippet"),
        confidence_level(F.col("confidence_score")).alias("confidence"),
    )


def asset_view(assets: DataFrame) -> DataFrame:
    """The listing form of an asset. Its evidence is a table of its own; ask
    ``evidence_chunks`` for it in lists of bounded length."""
    have = [c for c in (
        "asset_id", "algorithm", "algorithm_family", "primitive_type", "key_length_bits", "curve", "mode", "padding",
        "implementation_library", "location", "finding_count", "confidence_level", "quantum_vulnerable",
        "quantum_threat_type", "classical_security_status", "quantum_security_status",
        "effective_classical_security_bits", "effective_quantum_security_bits", "classification_notes",
        "risk_score", "risk_severity",
    ) if c in assets.columns]
    return assets.select(*have, F.round("confidence_score", 4).alias("confidence_score"))


def asset_detail(assets: DataFrame, evidence: DataFrame, size: int = 1000) -> DataFrame:
    """The full form of an asset: its listing form with the ids, places and records of its
    findings in emission order, at most ``size`` in a row. An asset with more has further
    rows, told apart by ``part``; one without any has a row with empty lists. Assets that
    share an id share its findings."""
    # Dealt by id alone, the findings are numbered, nested and joined where they are.
    parts = evidence_chunks(evidence.repartition("asset_id"), size).select("asset_id", F.col("chunk").alias("part"), "supporting_findings")
    rationale = ["confidence_rationale"] if "confidence_rationale" in assets.columns else []
    view = asset_view(assets).columns
    held = assets.select(F.struct(*(F.col(c) if c != "confidence_score" else F.round(c, 4).alias(c) for c in view), *rationale).alias("asset"), "asset_id").join(parts, "asset_id", "left")
    found = F.coalesce("supporting_findings", F.array().cast(parts.schema["supporting_findings"].dataType))
    return held.select(
        "asset.*", F.coalesce("part", F.lit(0)).alias("part"), F.transform(found, lambda x: x["finding_id"]).alias("supporting_finding_ids"),
        F.transform(found, lambda x: x["location"]).alias("locations"), F.transform(found, lambda x: x.dropFields("emit_seq")).alias("supporting_findings"))


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with rank, its place from 1 on in an order (which should be total), written once as
    range-sorted files. Ranks come from row numbers within each range and the sizes of the
    ranges before it, so no task ever sorts or counts everything."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    sizes = rows.groupBy("_range").count()
    before = F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    before = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(before, "_range").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def page_at(placed: DataFrame, page: int, size: int) -> DataFrame:
    """Rows of a page (from 1 on) of a table with ranks; of a stored one, only the files whose
    ranks reach into the page are read."""
    first = (max(page, 1) - 1) * size
    return placed.where((F.col("rank") > first) & (F.col("rank") <= first + size)).orderBy("rank")


def risk_detail(risk: DataFrame) -> DataFrame:
    return risk.select("asset_id", F.col("risk_score").alias("score"), "severity", "rationale")


def timeline_detail(timeline: DataFrame) -> DataFrame:
    return timeline.select("asset_id", "urgency", "hndl_exposure", "inequality_triggered", "applicable")


def recommendation_detail(recs: DataFrame) -> DataFrame:
    return recs.select(
        "asset_id", "current_algorithm", "recommendation_type", "recommended_algorithm", "pqc_standard",
        "hybrid_recommendation", "migration_complexity", "confidence",
    )


def scan_summary(scans: DataFrame) -> DataFrame:
    """Status rows of scans: progress, duration in seconds, retention date; the discovery
    figures stay null until a scan has finished.

    Input: scan_id, created_at, started_at, completed_at, error_count, failed, findings,
    assets, files_scanned.
    """
    done = F.col("completed_at").isNotNull()
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return scans.select(
        "scan_id",
        scan_status(F.col("failed"), done, F.col("error_count")).alias("status"),
        iso("created_at").alias("created_at"),
        iso("completed_at").alias("completed_at"),
        ((micros("completed_at") - micros("started_at")) / 1e6).alias("duration_seconds"),
        iso(F.col("created_at") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
        *[F.when(done, F.col(c)).alias(c) for c in ("findings", "assets", "files_scanned")],
    )


def scan_status(failed: Column, done: Column, errors: Column) -> Column:
    return (
        F.when(failed, "FAILED").when(~done, "RUNNING").when(errors > 0, "PARTIAL").otherwise("COMPLETED")
    )
