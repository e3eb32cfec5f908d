"""Threshold bands and small score formulas, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegraph.model import PROVENANCE_NAMES

# Fixed values -------------------------------------------------------------
VERIFIED_FLOOR = 0.80
PARTIAL_FLOOR = 0.50
INFERENCE_DECAY = 0.8
CONFIDENCE_FLOOR = 0.25
MAX_INFERENCE_DEPTH = 3
# --------------------------------------------------------------------------


def ladder(score: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """Label of the first step whose bound the score reaches (bounds in falling order)."""
    first, *rest = steps
    out = F.when(score >= first[0], first[1])
    for bound, label in rest:
        out = out.when(score >= bound, label)
    return out.otherwise(default)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round6(x: Column) -> Column:
    """Six decimals, half to even, decided on the exact binary value.

    ``bround`` decides on the shortest decimal text, which can lie on the other side of a tie. Only a
    product that is exactly a half needs a closer look: the sign of its rounding error tells the side.
    """
    million = F.lit(1e6)
    product = x * million
    spread = x * F.lit(134217729.0)  # 2^27 + 1 splits x into two halves whose products are exact
    high = spread - (spread - x)
    error = (high * million - product) + (x - high) * million
    below = F.floor(product).cast("double")
    half = product - below == 0.5
    nearest = F.when(half & (error > 0.0), below + 1.0).when(half & (error < 0.0), below).otherwise(F.rint(product))
    return nearest / million


def provenance_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in PROVENANCE_NAMES]), rank + 1)


def validation_state(confidence: Column, inferred: Column) -> Column:
    return (
        F.when((confidence >= VERIFIED_FLOOR) & ~inferred, "VERIFIED")
        .when(confidence >= PARTIAL_FLOOR, "PARTIALLY_VERIFIED")
        .otherwise("THEORETICAL")
    )


def risk_band(score: Column) -> Column:
    return (
        F.when(score <= 25, "LOW").when(score <= 50, "MEDIUM").when(score <= 75, "HIGH").otherwise("CRITICAL")
    )


def path_severity(confidence: Column) -> Column:
    return ladder(confidence, [(0.95, "CRITICAL"), (0.8, "HIGH"), (0.5, "MEDIUM")], "LOW")


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "CRITICAL", 4).when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).otherwise(1)
    )


def decayed_confidence(base: Column, depth: Column) -> Column:
    """Confidence after ``depth`` inference hops; a negative depth is an error."""
    checked = F.when(depth < 0, F.raise_error(F.lit("depth must be >= 0")).cast("int")).otherwise(depth)
    return base * F.pow(F.lit(INFERENCE_DECAY), checked)


def inference_admissible(base: Column, depth: Column) -> Column:
    """Struct (admissible, confidence): within 1..3 hops and still at the confidence floor."""
    confidence = base * F.pow(F.lit(INFERENCE_DECAY), F.greatest(depth, F.lit(0)))
    within = (depth >= 1) & (depth <= MAX_INFERENCE_DEPTH)
    return F.struct(
        (within & (confidence >= CONFIDENCE_FLOOR)).alias("admissible"), confidence.alias("confidence")
    )
