"""Recommendations, governance, compliance, business units and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.functions.bands import ladder, severity_rank
from tidegraph.model import DAY
from tidegraph.operators.classify import assessment
from tidegraph.operators.topology import blast_counts, blast_of_few, blast_up_to, cycles
from tidegraph.plans.view import View
from tidegraph.session import stage, together

# Fixed values -------------------------------------------------------------
BLAST_STEPS = [(10, 20), (3, 10)]  # more impacted nodes than, points
FEW = 100  # recommendations whose blast radii are searched one by one
PRIORITY_STEPS = [(80, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM")]
EXPOSED_TITLE = "Exposed Database Detected"
UNOWNED_TITLE = "Critical Asset Missing Ownership"
IDENTITY_TITLE = "High Risk Identity Detected"
EXPOSED_DESCRIPTION = "Database %s is internet reachable."
EXPOSED_REASONS = ["Contains %s data", "Publicly accessible over the network", "Affects %s downstream dependencies"]
UNOWNED_DESCRIPTION = "Highly critical asset %s lacks Team, Technical, or Business ownership."
UNOWNED_REASONS = [
    "Criticality score is %s",
    "No direct or inherited ownership tags found",
    "Incident response will be delayed without clear owners",
]
IDENTITY_DESCRIPTION = "Identity %s possesses excessive privileges or high risk score."
IDENTITY_REASONS = ["Base risk score of %s", "Capable of impacting %s resources"]
EXPOSED_ACTIONS = [
    "Restrict inbound traffic to trusted networks only",
    "Move the database into a private subnet",
    "Ensure strong authentication is enforced",
]
UNOWNED_ACTIONS = [
    "Assign a Team or Technical owner via tagging",
    "Update the connected microservices to inherit ownership",
]
IDENTITY_ACTIONS = ["Review current IAM policies", "Apply principle of least privilege", "Ensure MFA is enforced"]
GAPS = [
    # short name, title, action, category
    ("own", "Unowned Asset Detected", "Assign Technical or Team Owner", "OWNERSHIP_GAP"),
    ("env", "Unclassified Asset", "Tag with valid environment (Prod, Staging, Dev)", "CLASSIFICATION_GAP"),
    ("sens", "Sensitive Data Missing Business Owner", "Assign Business Owner accountable for data", "ACCOUNTABILITY_GAP"),
]
FAILURE_REASON = "Failed due to %s risk: %s"
FRAMEWORKS = ["CIS", "NIST", "ISO 27001", "SOC 2", "PCI DSS"]
CONTROLS = [
    # framework, control id, title, description
    ("PCI DSS", "1.2", "Restrict connections to untrusted networks",
     "Build firewall and router configurations that restrict connections between untrusted networks and any system components in the CDE."),
    ("PCI DSS", "7.1", "Limit access to system components",
     "Limit access to system components and cardholder data to only those individuals whose job requires such access."),
    ("SOC 2", "CC6.1", "Logical Access Security",
     "The entity implements logical access security software, infrastructure, and architectures over protected information assets to protect them from security events."),
    ("SOC 2", "CC6.6", "External Threats",
     "The entity implements logical access security measures to protect against threats from sources outside its boundaries."),
    ("NIST", "PR.AC-3", "Remote Access is Managed", "Remote access is managed."),
    ("NIST", "PR.AC-4", "Access Permissions",
     "Access permissions and authorizations are managed, incorporating the principles of least privilege and separation of duties."),
]
CONTROL_MAP = [
    # category, title fragment, control id
    ("EXPOSURE", "Exposed Database", "1.2"),
    ("EXPOSURE", "Exposed Database", "CC6.6"),
    ("EXPOSURE", "Exposed Database", "PR.AC-3"),
    ("CRITICAL_ASSET", "Missing Ownership", "7.1"),
    ("CRITICAL_ASSET", "Missing Ownership", "CC6.1"),
    ("IDENTITY", "High Risk Identity", "7.1"),
    ("IDENTITY", "High Risk Identity", "CC6.1"),
    ("IDENTITY", "High Risk Identity", "PR.AC-4"),
]
REASONING = {
    "EXPOSURE": ("Rule Matched: Exposed Asset Detection", "Asset is internet reachable without restrictive boundaries."),
    "DATA_PROTECTION": ("Rule Matched: Sensitive Data Protection", "Asset contains sensitive data and lacks strict access controls."),
}
REASONING_NOTE = "Deterministic rule evaluation matched critical threshold."
DEFAULT_REASONING = ("Rule Matched: General Best Practices", "Asset flagged by intelligence engine.")
NEW_DAYS, DORMANT_DAYS = 1, 30
# --------------------------------------------------------------------------


def priority(risk: Column, exposed: Column, criticality: Column, sensitivity: Column, blast: Column) -> Column:
    wide = None
    for above, worth in BLAST_STEPS:
        wide = F.when(blast > above, worth) if wide is None else wide.when(blast > above, worth)
    points = (
        risk * F.lit(0.3) + F.when(exposed, 40).otherwise(0) + criticality * F.lit(0.2)
        + F.when(sensitivity == "Restricted", 30).when(sensitivity == "Confidential", 15).otherwise(0)
        + wide.otherwise(0)
    )
    return ladder(points, PRIORITY_STEPS, "LOW")


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _filled(templates: list[str], *values: str) -> list[Column]:
    """Texts with ``%s`` replaced by the columns, in order; texts without a mark stay as they are."""
    left = list(values)
    return [F.format_string(t, left.pop(0)) if "%s" in t else F.lit(t) for t in templates]


def _rule(condition: Column, number: int, short: str, category: str, title: str, description: str, reasons: list[Column], actions: list[str]) -> Column:
    return F.when(condition, F.struct(
        F.lit(number).alias("rule"), F.concat(F.lit(f"rec-{short}-"), "id").alias("id"), F.lit(category).alias("category"), F.lit(title).alias("title"),
        F.format_string(description, "name").alias("description"), F.array(*reasons).alias("reasons"), _texts(actions).alias("actions"),
    ))


def _rules() -> tuple[Column, Column]:
    """Whether a row of the assessment is named by a rule, and the recommendations of those that name it."""
    exposed_store = F.col("exposed_store")
    unowned = F.col("business_level").isin("High", "Critical") & ~F.col("owned")
    risky = (F.col("type") == "IDENTITY") & (F.col("risk") > 70)
    reach = "total_impacted"
    found = F.array_compact(F.array(
        _rule(exposed_store, 1, "exp-db", "EXPOSURE", EXPOSED_TITLE, EXPOSED_DESCRIPTION, _filled(EXPOSED_REASONS, "sensitivity", reach), EXPOSED_ACTIONS),
        _rule(unowned, 2, "own", "CRITICAL_ASSET", UNOWNED_TITLE, UNOWNED_DESCRIPTION, _filled(UNOWNED_REASONS, "business_score"), UNOWNED_ACTIONS),
        _rule(risky, 3, "id", "IDENTITY", IDENTITY_TITLE, IDENTITY_DESCRIPTION, _filled(IDENTITY_REASONS, "risk", reach), IDENTITY_ACTIONS),
    ))
    return exposed_store | unowned | risky, found


def _named(view: View) -> DataFrame:
    return assessment(view).where(_rules()[0])


def _recommended(named: DataFrame, blast: DataFrame) -> DataFrame:
    """Recommendations on nodes of the assessment; ``blast``: id and total_impacted of these nodes."""
    exposed = F.col("internet_asset") | F.col("internet_service") | F.col("exposed_store")
    severity = priority(F.col("risk"), exposed, F.col("business_score"), F.col("sensitivity"), F.col("total_impacted"))
    return named.join(blast.select("id", "total_impacted"), "id").select(F.col("id").alias("node_id"), severity.alias("severity"), F.explode(_rules()[1]).alias("r")).select(
        "r.id", "severity", "r.category", "r.title", "r.description", "r.reasons", "r.actions", F.array("node_id").alias("affected_nodes"), "node_id", "r.rule"
    )


def recommendations(view: View) -> DataFrame:
    """id, severity, category, title, description, reasons, actions, affected_nodes, node_id, rule.

    The rules run first; the exact blast radius is computed only for the nodes one of them names.
    """
    def build() -> DataFrame:
        together([lambda: assessment(view), lambda: cycles(view)])
        named = _named(view)
        return _recommended(named, blast_counts(view, named.select("id")))
    return view.keep("recommendations", build)


def findings(view: View) -> DataFrame:
    """The recommendations without their reasons, as most reports read them.

    The reasons alone tell how many nodes are impacted; the severity depends on whether these are more than the numbers of
    ``BLAST_STEPS``, so they are counted up to the first number above all of these.
    """
    def build() -> DataFrame:
        together([lambda: assessment(view), view.dependencies])
        named = _named(view)
        return _recommended(named, blast_up_to(view, max(above for above, _ in BLAST_STEPS) + 1, named.select("id"))).drop("reasons")
    return recommendations(view).drop("reasons") if view.has("recommendations") else view.keep("findings", build)


def recommendation_order() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("node_id").asc(), F.col("rule").asc()]


def _in_full(view: View, ids: DataFrame) -> DataFrame:
    """Recommendations of at most ``FEW`` ids (staged; id and node_id), whose blast radii are searched from their nodes alone."""
    named = _named(view).join(ids.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    blast = blast_of_few(view, named.select("id"))
    rows = recommendations(view) if blast is None else _recommended(named, blast)
    return rows.join(ids.select("id"), "id", "left_semi")


def top_recommendations(view: View, limit: int = 5) -> DataFrame:
    rows = recommendations(view) if view.has("recommendations") or limit > FEW else _in_full(
        view, stage(findings(view).orderBy(*recommendation_order()).limit(limit).select("id", "node_id"), "top"))
    return rows.orderBy(*recommendation_order()).limit(limit)


def recommendation_by_id(view: View, rec_id: str) -> DataFrame:
    if view.has("recommendations"):
        return recommendations(view).where(F.col("id") == rec_id)
    own = _named(view).withColumn("total_impacted", F.lit(0)).select(F.col("id").alias("node_id"), F.explode(_rules()[1]).alias("r"))
    return _in_full(view, stage(own.select("r.id", "node_id").where(F.col("id") == rec_id), "asked"))


def governance(view: View) -> DataFrame:
    """Ownership, classification and accountability gaps."""
    unowned = ~F.col("owned") & F.col("type").isin("ASSET", "DATASTORE", "SERVICE")
    unclassified = (F.col("environment") == "Unknown") & F.col("type").isin("ASSET", "DATASTORE")
    unaccounted = F.col("sensitivity").isin("Restricted", "Confidential") & F.col("business").isNull()
    severities = [F.when(F.col("environment") == "Production", "HIGH").otherwise("MEDIUM"), F.lit("MEDIUM"), F.lit("CRITICAL")]
    gaps = F.array_compact(F.array(*[
        F.when(condition, F.struct(
            F.lit(number).alias("rule"), F.concat(F.lit(f"gov-{short}-"), "id").alias("id"), F.lit(title).alias("title"), severity.alias("severity"),
            F.lit(action).alias("action"), F.lit(category).alias("category"),
        ))
        for number, (condition, severity, (short, title, action, category)) in enumerate(zip([unowned, unclassified, unaccounted], severities, GAPS), 1)
    ]))
    rows = assessment(view).select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.explode(gaps).alias("g"))
    return rows.select("g.id", "g.title", "g.severity", "g.action", "target_id", "target_name", "g.category", "g.rule")


def governance_order() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("target_id").asc(), F.col("rule").asc()]


def _catalogue(view: View) -> DataFrame:
    return view.log.sparkSession.createDataFrame(CONTROLS, "framework string, control_id string, control_title string, control_description string")


def _failing(view: View, recs: DataFrame) -> DataFrame:
    """Rows with category and title of recommendations, and each control they fail."""
    mapping = view.log.sparkSession.createDataFrame(CONTROL_MAP, "category string, fragment string, control_id string")
    return recs.join(F.broadcast(mapping), "category").where(F.contains("title", "fragment"))


def control_failures(view: View) -> DataFrame:
    """Every (recommendation, control) pair: which recommendation fails which control."""
    return _failing(view, findings(view).withColumnRenamed("id", "recommendation_id")).join(F.broadcast(_catalogue(view)), "control_id").select(
        "framework", "control_id", "control_title", "control_description", "recommendation_id", "node_id", "rule", "severity", "title",
        F.format_string(FAILURE_REASON, "severity", "title").alias("reason"), F.col("affected_nodes").alias("evidence_nodes"),
    )


def control_status(view: View) -> DataFrame:
    """The six controls with their first failure in severity order, if any."""
    first = control_failures(view).groupBy("control_id").agg(F.min_by(
        F.struct("recommendation_id", "reason", "evidence_nodes"), F.struct(-severity_rank(F.col("severity")), F.col("node_id"), F.col("rule"))
    ).alias("f"))
    return F.broadcast(_catalogue(view)).join(first, "control_id", "left").select(
        "framework", "control_id", "control_title", "control_description", F.col("f").isNull().alias("passed"), "f.recommendation_id", "f.reason", "f.evidence_nodes"
    )


def compliance(view: View) -> DataFrame:
    """Score per framework: share of passed controls in whole percent, 100 without controls.

    A control passes unless a rule that fails it names a node, whatever the severity.
    """
    frameworks = view.log.sparkSession.createDataFrame([(f,) for f in FRAMEWORKS], "framework string")
    kinds = _named(view).withColumn("total_impacted", F.lit(0)).select(F.explode(_rules()[1]).alias("r")).select("r.category", "r.title").distinct()
    failed = _failing(view, kinds).select("control_id").distinct().withColumn("failed", F.lit(True))
    status = F.broadcast(_catalogue(view)).join(failed, "control_id", "left").withColumn("passed", F.col("failed").isNull())
    counts = status.groupBy("framework").agg(F.count("*").alias("controls"), F.count_if("passed").alias("passed"))
    return frameworks.join(counts, "framework", "left").na.fill(0).select(
        "framework", "controls", "passed", (F.col("controls") - F.col("passed")).alias("failed"),
        F.coalesce(F.floor(F.try_divide(F.col("passed"), F.col("controls")) * 100).cast("int"), F.lit(100)).alias("score"),
    )


def overall_compliance(view: View) -> DataFrame:
    return compliance(view).agg((F.sum("score").cast("int") / len(FRAMEWORKS)).cast("int").alias("overall_score"))


def business_units(view: View) -> DataFrame:
    """Per owning team: nodes, recommendations and security score.

    The nodes of a team are the table ``team_members``; a team can own most of the graph.
    """
    teams = team_members(view)
    sizes = teams.groupBy("team").agg(F.count("*").alias("asset_count"))
    recs = findings(view).select("severity", F.col("node_id").alias("id")).join(teams, "id").groupBy("team").agg(
        F.count("*").alias("recommendations"),
        F.sum(F.when(F.col("severity") == "CRITICAL", 10).when(F.col("severity") == "HIGH", 5).otherwise(0)).alias("penalty"),
    )
    return sizes.join(recs, "team", "left").na.fill(0).select(
        "team", "asset_count", F.lit(0).alias("critical_assets"), "recommendations", F.greatest(F.lit(0), F.lit(100) - F.col("penalty")).alias("security_score")
    )


def team_members(view: View) -> DataFrame:
    return assessment(view).select(F.coalesce("team", F.lit("Unassigned")).alias("team"), "id")


def lifecycle(view: View, now: float) -> DataFrame:
    """(state, id, name, type) of assets and datastores: orphaned (no live edge), new, dormant."""
    age = F.lit(now) - F.col("valid_from")
    things = view.attributes().where(F.col("type").isin("ASSET", "DATASTORE")).select("id", "name", "type", "valid_from")
    orphaned = things.join(view.degrees(), "id", "left_anti").select(F.lit("orphaned").alias("state"), "id", "name", "type")
    aged = things.select(
        F.when(age < NEW_DAYS * DAY, "new").when(age > DORMANT_DAYS * DAY, "dormant").alias("state"), "id", "name", "type"
    ).where(F.col("state").isNotNull())
    return orphaned.unionByName(aged)


def lifecycle_summary(view: View, now: float) -> DataFrame:
    """total_assets counts every live node, as the states do only for assets and datastores."""
    states = lifecycle(view, now).select("state").unionByName(view.nodes.select(F.lit("live").alias("state")))
    return states.agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("live", "total_assets"), ("orphaned", "orphaned_count"), ("dormant", "dormant_count"))])


def reasoning(recs: DataFrame) -> DataFrame:
    """Evidence chain of each recommendation: the rule step, then one step per affected node."""
    rule = text = None
    for category, (first, each) in REASONING.items():
        hit = F.col("category") == category
        rule = F.when(hit, first) if rule is None else rule.when(hit, first)
        text = F.when(hit, each) if text is None else text.when(hit, each)
    rule, text = rule.otherwise(DEFAULT_REASONING[0]), text.otherwise(DEFAULT_REASONING[1])
    steps = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("node_id"), rule.alias("description"))),
        F.transform("affected_nodes", lambda n: F.struct(n.alias("node_id"), text.alias("description"))),
    )
    return recs.select(
        F.col("id").alias("target_id"), F.lit("RECOMMENDATION").alias("type"), F.lit(REASONING_NOTE).alias("reasoning"),
        F.concat(F.lit("Reasoning for "), "title").alias("description"), steps.alias("steps"),
    )
