"""Confidence, severity and share arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CONFIDENCE_LEVELS = [(0.85, "VERY_HIGH"), (0.70, "HIGH"), (0.45, "MEDIUM"), (0.20, "LOW")]
SIGNAL_BASE = {"ast_api_call": 0.90, "known_import": 0.60, "regex_executable": 0.62, "regex_comment": 0.18}
SIGNAL_CAP = {"ast_api_call": 0.98, "known_import": 0.70, "regex_executable": 0.75, "regex_comment": 0.30}
BONUS_IMPORT, BONUS_ARGUMENT, BONUS_API = 0.05, 0.03, 0.02
SEVERITY_FLOORS = [(80, "CRITICAL"), (60, "HIGH"), (30, "MEDIUM")]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
# --- end of fixed values ----------------------------------------------------


def _tier(value: Column, floors: list[tuple[float, str]], lowest: str) -> Column:
    tier = F.lit(lowest)
    for floor, name in reversed(floors):
        tier = F.when(value >= floor, name).otherwise(tier)
    return F.when(value.isNotNull(), tier)


def confidence_level(score: Column) -> Column:
    return _tier(score, CONFIDENCE_LEVELS, "VERY_LOW")


def clamp(value: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def severity(score: Column) -> Column:
    """Severity of a 0-100 score; values outside are clamped first."""
    return _tier(clamp(score, 0, 100), SEVERITY_FLOORS, "LOW")


def detection_confidence(
    signal: str,
    base: Column | float | None = None,
    has_import: Column | bool = False,
    has_argument: Column | bool = False,
    has_api: Column | bool = False,
) -> Column:
    """Base score of a signal plus bonuses, capped per signal. The import bonus
    counts only for a call found in parsed code."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    score = as_col(SIGNAL_BASE[signal] if base is None else base)
    if signal == "ast_api_call":
        score = score + F.when(as_col(has_import), BONUS_IMPORT).otherwise(0.0)
    score = score + F.when(as_col(has_argument), BONUS_ARGUMENT).otherwise(0.0)
    score = score + F.when(as_col(has_api), BONUS_API).otherwise(0.0)
    return F.round(clamp(score, 0.0, SIGNAL_CAP[signal]), 4)


def share(part: Column, whole: Column) -> Column:
    """Fraction in 0..1; 0 when there is no whole."""
    return F.when(whole > 0, clamp(part / whole, 0.0, 1.0)).otherwise(F.lit(0.0))
