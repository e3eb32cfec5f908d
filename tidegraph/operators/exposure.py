"""Exposure findings from observed relationships, and the simpler exposure buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.functions.bands import round6, validation_state
from tidegraph.functions.ids import finding_id
from tidegraph.plans.view import View
from tidegraph.session import together

# Fixed values -------------------------------------------------------------
PUBLIC_ZONE_WORDS = ("internet", "public", "dmz")
HIGH_DEGREE = 3
# --------------------------------------------------------------------------


def public_zones(view: View) -> DataFrame:
    """Zones that face outside, by name or by classification."""
    named = F.col("key_name").rlike("|".join(PUBLIC_ZONE_WORDS))
    outside = F.col("classification") == "external"
    return view.attributes().where((F.col("type") == "ZONE") & (named | outside)).select("id")


def _public_zone_edges(view: View) -> DataFrame:
    zones = public_zones(view).withColumnRenamed("id", "dst")
    return view.links("IN_ZONE").join(zones, "dst", "left_semi").select(F.col("src").alias("id"), F.col("id").alias("edge_id"), "confidence")


def in_public_zone(view: View) -> DataFrame:
    """Nodes inside a public zone, with the weakest confidence of those memberships."""
    return view.keep("in_public_zone", lambda: (
        _public_zone_edges(view).groupBy("id").agg(F.min("confidence").alias("zone_confidence"))
    ))


def reachable_assets(view: View) -> DataFrame:
    """Assets reachable from outside: id, inferred, confidence, in_zone, via_edge.

    Directly: in a public zone or flagged public. Inferred: one CONNECTS_TO step, either way, from such
    an asset; of several steps the first by asset, outgoing before incoming, then by edge.
    """
    return view.keep("reachable_assets", lambda: _reachable(view))


def _reachable(view: View) -> DataFrame:
    assets = view.attributes().where(F.col("type") == "ASSET").select("id", "confidence", "public_flag")
    zoned = assets.join(in_public_zone(view), "id", "left")
    direct = zoned.where(F.col("public_flag") | F.col("zone_confidence").isNotNull()).select(
        "id", F.lit(False).alias("inferred"), F.least("confidence", "zone_confidence").alias("confidence"),
        F.col("zone_confidence").isNotNull().alias("in_zone"), F.lit(None).cast("string").alias("via_edge"),
    )
    wires = view.links("CONNECTS_TO")
    steps = wires.select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.lit(0).alias("way"), F.col("id").alias("edge_id"), F.col("confidence").alias("edge_confidence")).unionByName(
        wires.select(F.col("dst").alias("seed"), F.col("src").alias("id"), F.lit(1).alias("way"), F.col("id").alias("edge_id"), F.col("confidence").alias("edge_confidence"))
    )
    found = (
        steps.join(direct.select(F.col("id").alias("seed"), F.col("confidence").alias("seed_confidence")), "seed")
        .groupBy("id").agg(F.min_by(
            F.struct(F.least("seed_confidence", "edge_confidence").alias("confidence"), F.col("edge_id").alias("via_edge")),
            F.struct("seed", "way", "edge_id"),
        ).alias("s"))
    )
    one_step = found.join(assets.select("id"), "id", "left_semi").join(direct.select("id"), "id", "left_anti").select(
        "id", F.lit(True).alias("inferred"), "s.confidence", F.lit(False).alias("in_zone"), "s.via_edge"
    )
    return direct.unionByName(one_step)


def _hosted(view: View, node_type: str) -> DataFrame:
    """Nodes of a type hosted by a reachable asset, with the first such HOSTS edge by id."""
    hosts = reachable_assets(view).select(F.col("id").alias("src"), F.col("inferred").alias("host_inferred"), F.col("confidence").alias("host_confidence"))
    targets = view.nodes.where(F.col("type") == node_type).select(F.col("id").alias("dst"))
    return (
        view.links("HOSTS").join(hosts, "src").join(targets, "dst", "left_semi")
        .groupBy(F.col("dst").alias("id"))
        .agg(F.min_by(F.struct(F.col("id").alias("host_edge"), F.col("src").alias("host"), "host_inferred", "host_confidence"), F.col("id")).alias("h"))
        .select("id", "h.*")
    )


def exposure_findings(view: View) -> DataFrame:
    """finding_id, entity_id, finding_type, confidence, validation_state; one row per entity and type."""
    def build() -> DataFrame:
        together([view.attributes, view.degrees])
        return _finish(view, _raw_findings(view))
    return view.keep("exposure_findings", build)


def _row(entity: Column | str, finding_type: str, confidence: Column | str, inferred: Column) -> list[Column]:
    entity = F.col(entity) if isinstance(entity, str) else entity
    confidence = F.col(confidence) if isinstance(confidence, str) else confidence
    return [entity.alias("entity_id"), F.lit(finding_type).alias("finding_type"), confidence.alias("raw"), inferred.alias("inferred")]


def _raw_findings(view: View) -> DataFrame:
    no = F.lit(False)
    reach = reachable_assets(view)
    nodes = view.attributes().select("id", "type", "confidence", "public_flag")
    zoned = in_public_zone(view).select("id", F.lit(True).alias("zoned"))

    in_zone = reach.where("in_zone").select(*_row("id", "PUBLIC_ZONE_ASSET", "confidence", no))
    external = reach.select(*_row("id", "EXTERNALLY_REACHABLE_ASSET", "confidence", F.col("inferred")))
    services = _hosted(view, "SERVICE").join(nodes.select("id", "confidence"), "id").select(
        *_row("id", "INTERNET_FACING_SERVICE", F.least("host_confidence", "confidence"), F.col("host_inferred"))
    )
    stores = (
        nodes.where(F.col("type") == "DATASTORE").join(_hosted(view, "DATASTORE"), "id", "left").join(zoned, "id", "left")
        .where(F.col("host_edge").isNotNull() | F.col("zoned").isNotNull() | F.col("public_flag"))
        .select(*_row("id", "EXPOSED_DATASTORE", "confidence", F.coalesce("host_inferred", no)))
    )
    crossing = (
        view.links("CONNECTS_TO", "DEPENDS_ON")
        .join(zoned.select(F.col("id").alias("src"), F.col("zoned").alias("src_zoned")), "src", "left")
        .join(zoned.select(F.col("id").alias("dst"), F.col("zoned").alias("dst_zoned")), "dst", "left")
        .where(F.col("src_zoned").isNull() != F.col("dst_zoned").isNull())
        .select(*_row("id", "ZONE_BOUNDARY_CROSSING", "confidence", no))
    )
    on_nodes = in_zone.unionByName(external).unionByName(services).unionByName(stores)
    busy = view.degrees().where(F.col("degree") >= HIGH_DEGREE)
    connected = (
        nodes.select("id", "confidence").join(busy, "id", "left_semi")
        .join(on_nodes.select(F.col("entity_id").alias("id")), "id", "left_semi")
        .select(*_row("id", "HIGH_CONNECTIVITY_EXPOSED", "confidence", no))
    )
    return on_nodes.unionByName(crossing).unionByName(connected)


def _finish(view: View, raw: DataFrame) -> DataFrame:
    return raw.select(
        finding_id("exposure", F.col("entity_id"), view.context, view.as_of, F.col("finding_type")).alias("finding_id"),
        "entity_id", "finding_type", round6(F.col("raw")).alias("confidence"),
        validation_state(F.col("raw"), F.col("inferred")).alias("validation_state"),
    )


def exposure_evidence(view: View) -> DataFrame:
    """Evidence of each finding (entity_id, finding_type, ref), one row per reference.

    Every finding rests on certain nodes and edges; their references are joined, not collected.
    """
    reach = reachable_assets(view)
    assets = reach.select(F.col("id").alias("entity_id"), "via_edge")
    zone_edges = _public_zone_edges(view).select(F.col("id").alias("entity_id"), F.lit("edge").alias("target_kind"), F.col("edge_id").alias("target_id"))
    via = assets.where(F.col("via_edge").isNotNull()).select("entity_id", F.lit("edge").alias("target_kind"), F.col("via_edge").alias("target_id"))
    own = assets.where(F.col("via_edge").isNull()).select("entity_id", F.lit("node").alias("target_kind"), F.col("entity_id").alias("target_id"))
    direct_zone = zone_edges.join(own.select("entity_id"), "entity_id", "left_semi")
    asset_rests = own.unionByName(direct_zone).unionByName(via)

    def through_host(hosted: DataFrame) -> DataFrame:
        hosts = asset_rests.withColumnRenamed("entity_id", "host")
        return hosted.select(F.col("id").alias("entity_id"), "host").join(hosts, "host").select("entity_id", "target_kind", "target_id")

    def itself(df: DataFrame) -> DataFrame:
        return df.select("entity_id", F.lit("node").alias("target_kind"), F.col("entity_id").alias("target_id"))

    findings = exposure_findings(view)
    services, stores = _hosted(view, "SERVICE"), _hosted(view, "DATASTORE")
    host_edges = services.select(F.col("id").alias("entity_id"), F.lit("edge").alias("target_kind"), F.col("host_edge").alias("target_id"))

    def typed(name: str) -> DataFrame:
        return findings.where(F.col("finding_type") == name).select("entity_id")

    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("finding_type", F.lit(name))

    crossing = typed("ZONE_BOUNDARY_CROSSING").select("entity_id", F.lit("edge").alias("target_kind"), F.col("entity_id").alias("target_id"))
    rests = (
        mark(asset_rests.join(typed("PUBLIC_ZONE_ASSET"), "entity_id", "left_semi"), "PUBLIC_ZONE_ASSET")
        .unionByName(mark(asset_rests, "EXTERNALLY_REACHABLE_ASSET"))
        .unionByName(mark(through_host(services).unionByName(itself(typed("INTERNET_FACING_SERVICE"))).unionByName(host_edges), "INTERNET_FACING_SERVICE"))
        .unionByName(mark(itself(typed("EXPOSED_DATASTORE")).unionByName(through_host(stores)), "EXPOSED_DATASTORE"))
        .unionByName(mark(crossing, "ZONE_BOUNDARY_CROSSING"))
        .unionByName(mark(itself(typed("HIGH_CONNECTIVITY_EXPOSED")), "HIGH_CONNECTIVITY_EXPOSED"))
    )
    refs = view.evidence(wanted=rests.select("target_kind", "target_id"))
    return rests.join(refs, ["target_kind", "target_id"]).select("entity_id", "finding_type", "ref").distinct()


def exposure_magnitude(findings: DataFrame) -> DataFrame:
    """Largest finding confidence per entity."""
    return findings.groupBy("entity_id").agg(F.max("confidence").alias("exposure"))


def exposure_buckets(view: View) -> DataFrame:
    """Attribute-based exposure lists as (bucket, id, name, detail).

    cloud_resources (detail: provider), internet_reachable_assets, internet_reachable_services (detail:
    port), exposed_datastores (detail: product). A node can be in several.
    """
    rows = view.attributes().select("id", "name", F.explode(F.array_compact(F.array(
        F.when(F.col("has_cloud"), F.struct(F.lit("cloud_resources").alias("bucket"), F.col("cloud_provider").alias("detail"))),
        F.when(F.col("internet_asset"), F.struct(F.lit("internet_reachable_assets").alias("bucket"), F.lit(None).cast("string").alias("detail"))),
        F.when(F.col("internet_service"), F.struct(F.lit("internet_reachable_services").alias("bucket"), F.col("port").cast("int").cast("string").alias("detail"))),
        F.when(F.col("exposed_store"), F.struct(F.lit("exposed_datastores").alias("bucket"), F.coalesce("signature", F.lit("unknown")).alias("detail"))),
    ))).alias("b"))
    return rows.select("b.bucket", "id", "name", "b.detail")
