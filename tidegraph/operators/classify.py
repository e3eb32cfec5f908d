"""Environment, data sensitivity, ownership and business criticality of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.functions.bands import ladder
from tidegraph.operators.scoring import scores
from tidegraph.operators.topology import dependency_counts
from tidegraph.plans.view import View
from tidegraph.session import together

# Fixed values -------------------------------------------------------------
ENVIRONMENT_TAGS = {
    "Production": ["prod", "production"],
    "Staging": ["stage", "staging"],
    "Development": ["dev", "development"],
    "Testing": ["test", "testing"],
}
ENVIRONMENT_NAMES = {
    "Production": ["-prod", "prod-", "production"],
    "Staging": ["-stg", "-stage", "staging"],
    "Development": ["-dev", "dev-", "development"],
    "Testing": ["-test", "test-"],
}
SENSITIVITY_TAGS = {
    "Restricted": ["restricted", "highly_confidential", "pci", "phi"],
    "Confidential": ["confidential", "pii"],
    "Internal": ["internal"],
    "Public": ["public", "open"],
}
RESTRICTED_STORE_NAMES = ["customer", "user", "account", "billing", "payment"]
INTERNAL_STORE_NAMES = ["log", "metrics", "telemetry"]
SENSITIVE_SERVICE_NAMES = ["payment", "auth", "login"]
TAG_EVIDENCE = "Explicit tag: %s"
RESTRICTED_EVIDENCE = "Name implies sensitive data: %s"
INTERNAL_EVIDENCE = "Name implies internal data: %s"
STORE_EVIDENCE = "Datastores default to Confidential"
SERVICE_EVIDENCE = "Service name implies sensitive handling: %s"
INHERITED_EVIDENCE = "Connects to %s datastore (%s)"
DEFAULT_EVIDENCE = "Default service classification"
REASONS = {
    "hub": "High connectivity (degree: %s)",
    "busy": "Moderate connectivity (degree: %s)",
    "needed": "High downstream dependency (%s assets depend on this)",
    "used": "Provides services to %s downstream assets",
    "internet": "Internet accessible",
    "store": "Externally exposed datastore",
    "restricted": "Processes or stores Restricted data",
    "confidential": "Processes or stores Confidential data",
}
LEVELS = [(80, "Critical"), (50, "High"), (25, "Medium")]
ROLES = ("team", "technical", "business")
BUSY_KINDS = ("LoadBalancer", "BlobStorage")
# --------------------------------------------------------------------------


def _names(words: list[str]) -> Column:
    return F.col("folded_name").rlike("|".join(words))


def environment_column() -> Column:
    """Environment from the tag, else from the name, over the parsed attributes."""
    out = None
    for label, tags in ENVIRONMENT_TAGS.items():
        hit = F.col("env_tag").isin(tags)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    for label, words in ENVIRONMENT_NAMES.items():
        out = out.when(_names(words), label)
    return out.otherwise("Unknown")


def environment(view: View) -> DataFrame:
    return view.attributes().select("id", environment_column().alias("environment"))


def _verdict(level: str, confidence: float, kind: str, why: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("evidence_kind"), why.alias("evidence")
    )


def _own_sensitivity() -> Column:
    """Verdict from the node's own tags, type and name; NULL where its dependents decide."""
    store, service = F.col("type") == "DATASTORE", F.col("type") == "SERVICE"
    out = None
    for level, tags in SENSITIVITY_TAGS.items():
        verdict = _verdict(level, 1.0, "tag", F.format_string(TAG_EVIDENCE, "sensitivity_tag"))
        hit = F.col("sensitivity_tag").isin(tags)
        out = F.when(hit, verdict) if out is None else out.when(hit, verdict)
    return (
        out.when(store & _names(RESTRICTED_STORE_NAMES), _verdict("Restricted", 0.8, "name", F.format_string(RESTRICTED_EVIDENCE, "folded_name")))
        .when(store & _names(INTERNAL_STORE_NAMES), _verdict("Internal", 0.7, "name", F.format_string(INTERNAL_EVIDENCE, "folded_name")))
        .when(store, _verdict("Confidential", 0.5, "type", F.lit(STORE_EVIDENCE)))
        .when(service & _names(SENSITIVE_SERVICE_NAMES), _verdict("Confidential", 0.7, "name", F.format_string(SERVICE_EVIDENCE, "folded_name")))
        .when(~service, _verdict("Unknown", 0.0, "none", F.lit(None).cast("string")))
    )


def sensitivity(view: View) -> DataFrame:
    """id, level, confidence, evidence_kind, evidence.

    A service without a verdict of its own takes the one of the first (by id) restricted or confidential
    datastore depending on it, at 0.9 of the confidence, else Internal.
    """
    def build() -> DataFrame:
        own = view.attributes().select("id", "type", _own_sensitivity().alias("v"))
        stores = own.where((F.col("type") == "DATASTORE") & F.col("v.level").isin("Restricted", "Confidential"))
        stores = stores.select(F.col("id").alias("consumer"), F.col("v.level").alias("level"), F.col("v.confidence").alias("confidence"))
        undecided = own.where(F.col("v").isNull()).select(F.col("id").alias("provider"))
        passed = (
            view.dependencies().join(stores, "consumer").join(undecided, "provider", "left_semi")
            .groupBy(F.col("provider").alias("id"))
            .agg(F.min_by(F.struct("level", "confidence", "consumer"), F.col("consumer")).alias("s"))
        )
        inherited = F.struct(
            F.col("s.level").alias("level"), (F.col("s.confidence") * 0.9).alias("confidence"), F.lit("downstream").alias("evidence_kind"),
            F.format_string(INHERITED_EVIDENCE, "s.level", "s.consumer").alias("evidence"),
        )
        default = _verdict("Internal", 0.4, "default", F.lit(DEFAULT_EVIDENCE))
        final = F.coalesce("v", F.when(F.col("s").isNotNull(), inherited), default)
        return own.join(passed, "id", "left").select("id", final.alias("f")).select("id", "f.*")
    return view.keep("sensitivity", build)


def ownership(view: View) -> DataFrame:
    """id, team, technical, business; a missing role comes from the first dependent (by id) having it."""
    def build() -> DataFrame:
        own = view.attributes().select("id", *ROLES)
        any_role = F.coalesce(*ROLES).isNotNull()
        lenders = own.where(any_role).withColumnRenamed("id", "consumer")
        lent = view.dependencies().join(lenders, "consumer").groupBy(F.col("provider").alias("id")).agg(*[
            F.min_by(role, F.when(F.col(role).isNotNull(), F.col("consumer"))).alias(f"lent_{role}") for role in ROLES
        ])
        return own.join(lent, "id", "left").select("id", *[F.coalesce(role, f"lent_{role}").alias(role) for role in ROLES])
    return view.keep("ownership", build)


def business_criticality(view: View) -> DataFrame:
    """id, level, score and the list of reasons."""
    return assessment(view).select("id", F.col("business_level").alias("level"), F.col("business_score").alias("score"), F.col("reasons").alias("factors"))


def assessment(view: View) -> DataFrame:
    """All classifications and scores of a live node in one row; the rules read this table."""
    def build() -> DataFrame:
        together([view.attributes, view.degrees, view.dependencies])
        together([lambda: scores(view), lambda: sensitivity(view), lambda: ownership(view)])
        degree, down = F.col("degree"), F.col("downstream")
        internet = F.col("internet_asset") | F.col("internet_service")
        # (condition, points, reason), first match of each group
        groups = [
            [(degree > 10, 20, F.format_string(REASONS["hub"], degree)),
             (degree > 3, 10, F.format_string(REASONS["busy"], degree))],
            [(down > 5, 30, F.format_string(REASONS["needed"], down)),
             (down > 0, 15, F.format_string(REASONS["used"], down))],
            [(internet, 25, F.lit(REASONS["internet"]))],
            [(F.col("exposed_store"), 40, F.lit(REASONS["store"]))],
            [(F.col("sensitivity") == "Restricted", 40, F.lit(REASONS["restricted"])),
             (F.col("sensitivity") == "Confidential", 25, F.lit(REASONS["confidential"]))],
        ]
        points, reasons = F.lit(0), []
        for group in groups:
            value = reason = None
            for condition, worth, why in group:
                value = F.when(condition, worth) if value is None else value.when(condition, worth)
                reason = F.when(condition, why) if reason is None else reason.when(condition, why)
            points = points + value.otherwise(0)
            reasons.append(reason)
        base = (
            view.attributes().withColumn("environment", environment_column())
            .select("id", "type", "name", "environment", "internet_asset", "internet_service", "exposed_store", "valid_from", "tags_json", "confidence")
            .join(scores(view).select("id", "degree", "criticality", "risk", "risk_category"), "id")
            .join(dependency_counts(view).select("id", "upstream", "downstream"), "id")
            .join(sensitivity(view).select("id", F.col("level").alias("sensitivity")), "id")
            .join(ownership(view), "id")
        )
        scored = base.withColumn("business_score", points).withColumn("reasons", F.array_compact(F.array(*reasons)))
        return scored.withColumn("business_level", ladder(F.col("business_score"), LEVELS, "Low")).withColumn(
            "owned", F.coalesce(*ROLES).isNotNull()
        )
    return view.keep("assessment", build)


def rank_critical_assets(view: View, limit: int = 50) -> DataFrame:
    """Assets, datastores and services by 2 x degree + 5 x dependents + base, highest first, ties by id."""
    base = F.when(F.col("kind").isin(*BUSY_KINDS), 10).otherwise(1) + F.when(F.col("has_cloud"), 5).otherwise(0)
    return (
        view.attributes().where(F.col("type").isin("ASSET", "DATASTORE", "SERVICE"))
        .select("id", "name", "type", base.alias("base_risk"))
        .join(view.degrees(), "id", "left").join(dependency_counts(view).select("id", "downstream"), "id", "left")
        .na.fill(0, ["degree", "downstream"])
        .select("id", "name", "type", F.col("degree").alias("centrality"), F.col("downstream").alias("downstream_dependencies"),
                "base_risk", (F.col("degree") * 2 + F.col("downstream") * 5 + F.col("base_risk")).alias("criticality_score"))
        .orderBy(F.col("criticality_score").desc(), "id").limit(limit)
    )


def inventory(view: View) -> DataFrame:
    """Assets, datastores, services and identities with environment, criticality and tags."""
    return assessment(view).where(F.col("type").isin("ASSET", "DATASTORE", "SERVICE", "IDENTITY")).select(
        "id", "name", "type", "environment", F.col("business_level").alias("criticality"),
        F.col("business_score").alias("criticality_score"), F.coalesce("tags_json", F.lit("{}")).alias("tags"),
    )


def asset_details(view: View, node_id: str) -> DataFrame:
    """Everything known about one node: attributes, environment, owners, sensitivity, criticality."""
    return assessment(view).where(F.col("id") == node_id).join(view.nodes.select("id", F.col("value_json").alias("attributes")), "id").select(
        "id", "type", "name", "attributes", "environment", "team", "technical", "business", "sensitivity",
        F.col("business_level").alias("criticality"), F.col("business_score").alias("criticality_score"), "reasons",
    )
