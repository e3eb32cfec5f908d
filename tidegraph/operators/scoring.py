"""Criticality and risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.functions.bands import clamp, risk_band, round6
from tidegraph.functions.ids import finding_id
from tidegraph.operators.exposure import exposure_evidence, exposure_findings, exposure_magnitude
from tidegraph.operators.topology import dependency_counts
from tidegraph.plans.view import View
from tidegraph.session import together

# Fixed values -------------------------------------------------------------
WEIGHTS = {
    "business_importance": 0.30,
    "dependency_centrality": 0.25,
    "exposure": 0.20,
    "connectivity": 0.15,
    "change_frequency": 0.10,
}
DEPENDENCY_SCALE = 10.0
CONNECTIVITY_SCALE = 10.0
CHANGE_SCALE = 5.0
CHANGE_LIFT = 0.5
# --------------------------------------------------------------------------


def _measures(view: View) -> DataFrame:
    """One row per live node with everything the scores are made of."""
    magnitude = exposure_magnitude(exposure_findings(view)).withColumnRenamed("entity_id", "id")
    return (
        view.attributes().select("id", "type", "name", "confidence", "importance", "changes")
        .join(dependency_counts(view).select("id", "total"), "id", "left")
        .join(view.degrees(), "id", "left").join(magnitude, "id", "left")
        .na.fill(0, ["total", "degree"]).na.fill(0.0, ["exposure"])
    )


def _change_share() -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("changes") - 1) / CHANGE_SCALE)


def _factors() -> dict[str, Column]:
    return {
        "business_importance": clamp(F.col("importance")),
        "dependency_centrality": F.least(F.lit(1.0), F.col("total") / DEPENDENCY_SCALE),
        "exposure": clamp(F.col("exposure")),
        "connectivity": F.least(F.lit(1.0), F.col("degree") / CONNECTIVITY_SCALE),
        "change_frequency": _change_share(),
    }


def scores(view: View) -> DataFrame:
    """Criticality and risk of every live node in one row; staged, as most rules read it."""
    def build() -> DataFrame:
        together([lambda: exposure_findings(view), lambda: dependency_counts(view), view.degrees])
        factors = _factors()
        total = None
        for name, factor in factors.items():
            part = F.lit(WEIGHTS[name]) * factor
            total = part if total is None else total + part
        lift = F.lit(1.0) + F.least(F.lit(CHANGE_LIFT), _change_share() * CHANGE_LIFT)
        raw = F.col("exposure") * (F.col("criticality") / 100.0) * F.col("confidence")
        return (
            _measures(view)
            .withColumn("criticality", F.bround(F.lit(100) * total).cast("int"))
            .withColumn("change_multiplier", lift)
            .withColumn("risk", F.bround(F.least(F.lit(100.0), F.lit(100.0) * raw * F.col("change_multiplier"))).cast("int"))
            .withColumn("risk_category", risk_band(F.col("risk")))
        )
    return view.keep("scores", build)


def criticality(view: View) -> DataFrame:
    """Criticality 0 to 100 per live node, with value, weight and contribution of each factor."""
    breakdown = F.create_map(*[
        x for name, factor in _factors().items() for x in (
            F.lit(name),
            F.struct(round6(factor).alias("value"), F.lit(WEIGHTS[name]).alias("weight"),
                     round6(F.lit(WEIGHTS[name]) * factor).alias("contribution")),
        )
    ])
    return scores(view).select(
        finding_id("criticality", F.col("id"), view.context, view.as_of).alias("finding_id"),
        F.col("id").alias("entity_id"), F.col("criticality").alias("score"), breakdown.alias("factors"), "confidence",
    )


def risk(view: View) -> DataFrame:
    """Risk 0 to 100 and its band per live node, with the factors it is the product of."""
    return scores(view).select(
        finding_id("risk", F.col("id"), view.context, view.as_of).alias("finding_id"),
        F.col("id").alias("entity_id"), F.col("risk").alias("score"), F.col("risk_category").alias("category"),
        round6(F.col("confidence")).alias("confidence"), round6(F.col("exposure")).alias("exposure_score"),
        F.col("criticality").alias("criticality_score"), round6(F.col("change_multiplier")).alias("change_multiplier"),
    )


def risk_evidence(view: View) -> DataFrame:
    """References behind each node's risk: its own and those of its exposure findings."""
    live = view.nodes.select(F.lit("node").alias("target_kind"), F.col("id").alias("target_id"))
    own = view.evidence("node", live).select(F.col("target_id").alias("entity_id"), "ref")
    found = exposure_evidence(view).select("entity_id", "ref")
    found = found.join(view.nodes.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return own.unionByName(found).distinct()


def risk_of(view: View, node_id: str) -> DataFrame:
    """Risk of one node; 0 and LOW for a node without a finding."""
    hit = risk(view).where(F.col("entity_id") == node_id)
    wanted = view.log.sparkSession.range(1).select(F.lit(node_id).alias("entity_id"))
    return wanted.join(hit, "entity_id", "left").select(
        "entity_id", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("category", F.lit("LOW")).alias("category"),
        "exposure_score", "criticality_score", "change_multiplier", "confidence",
    )
