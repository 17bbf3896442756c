"""The stages from files to reports, composed lazily."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import components, listing, merge, recommend, reports, risk, timeline
from keystrata.operators.classify import classify
from keystrata.operators.normalize import normalize
from keystrata.session import checkpointed
from keystrata.sources import mixed
from keystrata.sources.files import read_problems


def _checked(**durations: float | None) -> None:
    for name, value in durations.items():
        if value is not None and not (math.isfinite(value) and value >= 0):
            raise ValueError(f"{name} must be a finite number of years, not below 0: {value}")


def assessed(assets: DataFrame, inputs: DataFrame | None, config: timeline.TimelineConfig) -> DataFrame:
    """Classified assets as the struct ``asset`` with ``risk``, ``timeline`` and ``advice``
    beside it. All three depend on the asset's own row, so nothing is joined, and assets that
    share an id stay apart."""
    row = F.struct(*assets.columns).alias("asset")
    df = assets.select(*assets.columns, row)
    scored = risk.score_risk(df, keep=("asset",))
    df = scored.select("asset.*", "asset", F.struct(*(c for c in scored.columns if c != "asset")).alias("risk"))
    timed = timeline.assess_timeline(df, inputs, config, keep=("asset", "risk"))
    df = timed.select("asset.*", "asset", "risk", F.struct(*(c for c in timed.columns if c not in ("asset", "risk"))).alias("timeline"))
    advised = recommend.recommend(df, keep=("asset", "risk", "timeline"))
    advice = F.struct(*(c for c in advised.columns if c not in ("asset", "risk", "timeline"))).alias("advice")
    return advised.select("asset", "risk", "timeline", advice)


def analyse(
    findings: DataFrame, x: float | None = None, y: float | None = None, z: float | None = None,
    inputs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every stage table and report of a table of findings.

    Normalised findings and assets feed several branches, so both are written once to the
    checkpoint folder; all else is lazy. X, Y and Z apply to every asset that has no inputs of its own;
    a missing value is never taken for zero. Inputs that are no valid duration are left out
    and returned as ``invalid_durations``. Every asset is assessed, also where two share an id.
    """
    _checked(x=x, y=y, z=z)
    assets, evidence = merge.build_assets(normalize(findings))
    assets = checkpointed(risk.with_risk(classify(assets)))
    config = timeline.TimelineConfig(
        quantum_arrival_years=timeline.TimelineConfig().quantum_arrival_years if z is None else z,
        protected_lifetime_years=x, migration_time_years=y,
    )
    problems = None
    if inputs is not None:
        problems = timeline.invalid_durations(inputs)
        valid = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) >= 0)
        inputs = inputs.withColumns({c: F.when(valid(c), F.col(c)) for c in timeline.INPUT_COLUMNS})
    every = assessed(assets, inputs, config)
    scores, times, recs = every.select("risk.*"), every.select("timeline.*"), every.select("advice.*")
    parts = components.to_components(assets)
    out = {
        "findings": findings,
        "assets": assets,
        "evidence": evidence,
        "asset_metadata": merge.asset_metadata(evidence),
        "risk": scores,
        "timeline": times,
        "recommendations": recs,
        "components": parts,
        "component_evidence": components.component_evidence(evidence),
        "index": every.select("asset.*", *(f"timeline.{c}" for c in reports.INDEX_TIMELINE), *(f"advice.{c}" for c in reports.INDEX_ADVICE)),
        "inventory": every.select(*reports.inventory_columns()),
        "normalization_stats": reports.normalization_stats(findings, assets),
        "asset_distributions": reports.asset_distributions(assets),
        "scan_stats": reports.scan_stats(findings),
        "risk_report": risk.risk_report(assets),
        "timeline_report": timeline.timeline_report(times),
        "highest_urgency": timeline.highest_urgency(times),
        "recommendation_report": recommend.recommendation_report(recs),
        "recommendation_distributions": recommend.recommendation_distributions(recs),
        "component_summary": components.component_summary(parts),
    }
    return out if problems is None else out | {"invalid_durations": problems}


def run(
    files: DataFrame, kind: str | None = None, x: float | None = None, y: float | None = None, z: float | None = None,
    roots: tuple[str, ...] = ("",), symbols: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Scan files and analyse the findings. Files that come with their content are routed row
    by row to the scanners for source, binaries and container filesystems (see
    ``sources.mixed``); ``kind`` (repository or container) has all of them read as that, as
    have files that come as text only. Where there is content, ``errors`` lists the files that
    could not be read as text, and ``status`` is PARTIAL if there are any."""
    from keystrata.sources.container import scan_container
    from keystrata.sources.repository import scan_repository

    if kind is None and "content" in files.columns:
        return _of_scan(mixed.scan_files_mixed(files, roots, symbols), x, y, z)
    findings = checkpointed({"repository": scan_repository, "container": scan_container}[kind or "repository"](files))
    out = analyse(findings, x, y, z)
    if "content" in files.columns:
        errors = read_problems(files)
        out |= {"errors": errors, "status": scan_status(errors)}
    return out


def run_tree(
    spark: SparkSession, root: str, x: float | None = None, y: float | None = None, z: float | None = None,
    roots: tuple[str, ...] = ("",), symbols: DataFrame | None = None, exclude: list[str] | None = None, large: int = mixed.LARGE,
) -> dict[str, DataFrame]:
    """As ``run`` for everything below a folder, files of any size."""
    return _of_scan(mixed.scan_tree(spark, root, roots, symbols, exclude, large), x, y, z)


def _of_scan(scan: mixed.Scan, x: float | None, y: float | None, z: float | None) -> dict[str, DataFrame]:
    out = analyse(checkpointed(scan.findings), x, y, z)
    return out | {"errors": scan.errors, "status": scan_status(scan.errors), "counters": scan.counters}


def scan_status(errors: DataFrame, failed: bool = False) -> DataFrame:
    """COMPLETED, PARTIAL (some file could not be read) or FAILED."""
    return errors.agg(F.count(F.lit(1)).alias("error_count")).select(
        "error_count",
        listing.scan_status(F.lit(failed), F.lit(True), F.col("error_count")).alias("status"),
    )
