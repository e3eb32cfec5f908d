"""Report tables, and their CSV and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegraph.operators.classify import assessment
from tidegraph.operators.exposure import exposure_findings
from tidegraph.operators.rules import compliance, control_failures, control_status, findings, governance, governance_order, overall_compliance, recommendation_order
from tidegraph.operators.scoring import scores
from tidegraph.plans.view import View


def executive(view: View) -> DataFrame:
    """total_nodes, total_assets, high_risk_count, critical_assets (every scored node), exposures_detected."""
    nodes = scores(view).select(
        F.lit(1).alias("node"), F.when(F.col("type") == "ASSET", 1).otherwise(0).alias("asset"),
        F.when(F.col("risk_category").isin("HIGH", "CRITICAL"), 1).otherwise(0).alias("high"), F.lit(0).alias("exposure"))
    found = exposure_findings(view).select(F.lit(0).alias("node"), F.lit(0).alias("asset"), F.lit(0).alias("high"), F.lit(1).alias("exposure"))
    sums = nodes.unionByName(found).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("node", "asset", "high", "exposure")])
    return sums.select(F.col("node").alias("total_nodes"), F.col("asset").alias("total_assets"), F.col("high").alias("high_risk_count"),
                       F.col("node").alias("critical_assets"), F.col("exposure").alias("exposures_detected"))


def executive_top_risks(view: View, limit: int | None = None) -> DataFrame:
    """The risk findings in entity order: all of them, or the first ``limit``."""
    rows = risks(view).orderBy("entity_id")
    return rows if limit is None else rows.limit(limit)


def risks(view: View) -> DataFrame:
    return scores(view).select(F.col("id").alias("entity_id"), F.col("risk").alias("risk_score"), F.col("risk_category").alias("category"))


def technical(view: View) -> DataFrame:
    """Every live node with key and value."""
    return view.nodes.select("id", "type", "key_json", "value_json")


def asset_inventory(view: View) -> DataFrame:
    return assessment(view).where(F.col("type").isin("ASSET", "DATASTORE", "SERVICE")).select("id", "type", "environment")


def critical_assets(view: View) -> DataFrame:
    rows = assessment(view).where(F.col("business_level").isin("High", "Critical"))
    return rows.select("id", F.col("business_level").alias("criticality"), F.col("business_score").alias("score")).orderBy(F.col("score").desc(), "id")


def sensitive_data(view: View) -> DataFrame:
    return assessment(view).where(F.col("sensitivity").isin("Restricted", "Confidential")).select("id", "sensitivity")


def _listed(view: View, *severities: str) -> DataFrame:
    rows = findings(view)
    return rows.where(F.col("severity").isin(*severities)) if severities else rows


def action_plan(view: View) -> DataFrame:
    return _plan(_listed(view, "CRITICAL", "HIGH"))


def remediation(view: View) -> DataFrame:
    return _plan(_listed(view))


def _plan(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*recommendation_order()).select("id", "severity", "title", "description", F.coalesce(F.get("actions", F.lit(0)), F.lit("")).alias("primary_action"))


def critical_findings(view: View) -> DataFrame:
    return _listed(view, "CRITICAL").orderBy(*recommendation_order()).select("id", "title", "description", "category")


def ownership_report(view: View) -> DataFrame:
    return assessment(view).where("owned").select("id", "team", "technical", "business")


def board(view: View) -> DataFrame:
    """total_assets, critical_risks and compliance_score."""
    nodes = scores(view).select(F.when(F.col("type") == "ASSET", 1).otherwise(0).alias("asset"), F.when(F.col("risk_category") == "CRITICAL", 1).otherwise(0).alias("critical"), F.lit(0).alias("score"))
    score = overall_compliance(view).select(F.lit(0).alias("asset"), F.lit(0).alias("critical"), F.col("overall_score").alias("score"))
    return nodes.unionByName(score).agg(F.sum("asset").alias("total_assets"), F.sum("critical").alias("critical_risks"), F.sum("score").alias("compliance_score"))


def compliance_report(view: View) -> DataFrame:
    """A row per failed control of each framework, or one row 'None' for a framework without."""
    failed = control_status(view).where(~F.col("passed")).select("framework", F.col("control_id").alias("failed_control"), "reason")
    return compliance(view).select("framework", "score").join(failed, "framework", "left").select(
        "framework", "score", F.coalesce("failed_control", F.lit("None")).alias("failed_control"), F.coalesce("reason", F.lit("")).alias("reason"))


def risk_total(view: View) -> DataFrame:
    return scores(view).agg(F.coalesce(F.sum("risk"), F.lit(0)).alias("total_risk"))


def governance_report(view: View) -> DataFrame:
    return governance(view).orderBy(*governance_order()).select("id", "severity", "title", F.col("target_name").alias("target"), "action", "category")


# report name -> tables; a report of several tables writes one folder per table
REPORTS = {
    "executive": {"summary": executive, "top_risks": executive_top_risks},
    "technical": {"nodes": technical, "risks": risks},
    "asset_inventory": {"assets": asset_inventory},
    "critical_assets": {"critical": critical_assets},
    "sensitive_data": {"sensitive": sensitive_data},
    "executive_action_plan": {"recommendations": action_plan},
    "risk_remediation": {"recommendations": remediation},
    "critical_findings": {"findings": critical_findings},
    "ownership": {"owners": ownership_report},
    "executive_board_report": {"board": board},
    "compliance_report": {"compliance": compliance_report, "failures": control_failures},
    "risk_trend_report": {"total": risk_total},
    "governance_report": {"findings": governance_report},
}


def write_report(view: View, report: str, path: str, form: str = "csv") -> list[str]:
    """Write a report's tables below ``path`` as CSV with header, or JSON lines; returns the folders."""
    if form not in ("csv", "json"):
        raise ValueError("form must be csv or json")
    written = []
    for table, make in REPORTS[report].items():
        rows, target = make(view), f"{path}/{report}/{table}"
        if form == "csv":
            flat = rows.select(*[F.concat_ws("; ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
            flat.write.mode("overwrite").option("header", True).csv(target)
        else:
            rows.write.mode("overwrite").json(target)
        written.append(target)
    return written
