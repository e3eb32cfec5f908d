"""From normalised observations to nodes, edges, assertions and discovery events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.functions.ids import canonical_context, canonical_json, content_id, edge_id, node_id
from tidegraph.model import DISCOVERY_EVENT
from tidegraph.plans.view import Graph

# Fixed values -------------------------------------------------------------
ASSET_KEYS = ("mac", "cloud_id", "hostname", "ip")
IDENTITY_KEYS = ("principal", "sid", "iam_id", "email")
KINDS = ("asset", "service", "identity", "datastore", "zone")
DEFAULT_CONFIDENCE = 0.9
DEFAULT_PROVENANCE = 3
# --------------------------------------------------------------------------


def first_key(columns: list[str], names: tuple[str, ...]) -> Column:
    """``{"name": value}`` of the first non-empty column; NULL if all are empty."""
    out = None
    for column, name in zip(columns, names):
        hit = F.coalesce(F.col(column) != "", F.lit(False))
        value = F.to_json(F.struct(F.col(column).alias(name)))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def asset_key() -> Column:
    return first_key(list(ASSET_KEYS), ASSET_KEYS)


def host_key() -> Column:
    return first_key([f"host_{k}" for k in ASSET_KEYS], ASSET_KEYS)


def identity_key() -> Column:
    return first_key(list(IDENTITY_KEYS), IDENTITY_KEYS)


def service_key(host: Column) -> Column:
    """Host and port, else host and signature, else host and metadata; port 0 is a port."""
    metadata = F.concat(F.lit('{"asset":"'), host, F.lit('","metadata":'), F.coalesce(canonical_json(F.col("metadata_json")), F.lit("{}")), F.lit("}"))
    return (
        F.when(F.col("port").isNotNull(), F.to_json(F.struct(host.alias("asset"), F.col("port").alias("port"))))
        .when(F.coalesce(F.col("product_signature") != "", F.lit(False)), F.to_json(F.struct(host.alias("asset"), F.col("product_signature").alias("signature"))))
        .otherwise(metadata)
    )


def datastore_key(host: Column) -> Column:
    """Cloud id, else host and name, else name."""
    return (
        F.when(F.coalesce(F.col("cloud_id") != "", F.lit(False)), F.to_json(F.struct(F.col("cloud_id").alias("cloud_id"))))
        .when(host.isNotNull() & F.coalesce(F.col("name") != "", F.lit(False)), F.to_json(F.struct(host.alias("asset"), F.col("name").alias("name"))))
        .otherwise(F.to_json(F.struct(F.col("name").alias("name"))))
    )


def zone_key(name: Column) -> Column:
    return F.to_json(F.struct(name.alias("name")))


@dataclass(frozen=True)
class Resolver:
    """How observations map to natural keys; replace a field to change it. All are column expressions."""

    asset: Callable[[], Column] = asset_key
    host: Callable[[], Column] = host_key
    identity: Callable[[], Column] = identity_key
    service: Callable[[Column], Column] = service_key
    datastore: Callable[[Column], Column] = datastore_key
    zone: Callable[[Column], Column] = zone_key


def with_defaults(observations: DataFrame) -> DataFrame:
    """Fill the documented defaults and sort the evidence (duplicates stay)."""
    return (
        observations.withColumn("context", canonical_context(F.col("context")))
        .withColumn("confidence", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)))
        .withColumn("provenance", F.coalesce("provenance", F.lit(DEFAULT_PROVENANCE)))
        .withColumn("valid_from", F.coalesce("valid_from", "observed_at"))
        .withColumn("evidence", F.array_sort(F.coalesce("evidence", F.array().cast("array<string>"))))
    )


def checked(observations: DataFrame) -> DataFrame:
    """Add ``problems``, the reasons a row cannot be built from (empty for a good row)."""
    full = with_defaults(observations)
    kind = F.col("kind")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    problems = {
        "unknown kind": ~F.coalesce(kind.isin(*KINDS), F.lit(False)),
        "confidence outside 0..1": ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)),
        "no evidence": (F.size("evidence") == 0) & (F.col("provenance") != 0),
        "valid_to before valid_from": F.coalesce(F.col("valid_to") < F.col("valid_from"), F.lit(False)),
        "no asset identifier": (kind == "asset") & asset_key().isNull(),
        "no host identifier": (kind == "service") & host_key().isNull(),
        "no identity identifier": (kind == "identity") & identity_key().isNull(),
        "service without port, signature or metadata": (kind == "service") & F.col("port").isNull() & empty("product_signature")
        & F.coalesce(F.col("metadata_json").isin("", "{}"), F.lit(True)),
        "datastore without cloud id or name": (kind == "datastore") & empty("cloud_id") & empty("name"),
        "zone without name": (kind == "zone") & empty("name"),
    }
    return full.withColumn("problems", F.array_compact(F.array(*[F.when(bad, reason) for reason, bad in problems.items()])))


def split_valid(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to build from, and rejected rows with their problems."""
    rows = checked(observations)
    good = F.size("problems") == 0
    return rows.where(good).drop("problems"), rows.where(~good)


def _value(low: dict[str, Column], high: dict[str, Column]) -> Column:
    """Canonical JSON of the attributes, over the ``low`` entries and under the ``high`` ones; NULL entries are left out."""
    bag = F.coalesce(F.from_json("attributes_json", "map<string,variant>"), F.create_map().cast("map<string,variant>"))

    def entries(items: dict[str, Column]) -> Column:
        if not items:
            return F.create_map().cast("map<string,variant>")
        every = F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v.cast("variant"))])
        return F.map_filter(every, lambda k, v: v.isNotNull())

    top = entries(high)
    middle = F.map_filter(bag, lambda k, v: ~F.map_contains_key(top, k))
    bottom = F.map_filter(entries(low), lambda k, v: ~F.map_contains_key(bag, k) & ~F.map_contains_key(top, k))
    return canonical_json(F.to_json(F.map_concat(bottom, middle, top)))


def _facts(rows: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("source", "context", "confidence", "provenance", "valid_from", "valid_to", "observed_at", "evidence")]


def _subjects(rows: DataFrame, resolver: Resolver, fold_metadata: bool) -> DataFrame:
    """Each observation with its node and, where it names one, its host."""
    kind = F.col("kind")
    host = F.when(kind.isin("service", "datastore"), resolver.host())
    hosted = rows.withColumn("host_key", host).withColumn("host_id", F.when(F.col("host_key").isNotNull(), node_id("ASSET", F.col("host_key"))))
    exists = {"exists": F.lit(True)}
    if fold_metadata:
        hosted = hosted.withColumn("attributes_json", F.when(kind == "service", F.coalesce("attributes_json", "metadata_json")).otherwise(F.col("attributes_json")))
    key = (
        F.when(kind == "asset", resolver.asset()).when(kind == "identity", resolver.identity()).when(kind == "service", resolver.service(F.col("host_id")))
        .when(kind == "datastore", resolver.datastore(F.col("host_id"))).when(kind == "zone", resolver.zone(F.col("name")))
    )
    value = (
        F.when(kind == "service", _value(exists, {"port": F.col("port"), "signature": F.nullif("product_signature", F.lit(""))}))
        .when(kind == "identity", _value(exists | {"identity_type": F.col("identity_type")}, {}))
        .when(kind.isin("datastore", "zone"), _value(exists | {"name": F.col("name")}, {}))
        .otherwise(_value(exists, {}))
    )
    return hosted.withColumn("type", F.upper(kind)).withColumn("key_json", key).withColumn("value_json", value).withColumn("node", node_id(F.upper(kind), F.col("key_json")))


def _relations(subjects: DataFrame, resolver: Resolver) -> DataFrame:
    """IN_ZONE, HOSTS and MEMBER_OF of the observations: edge type, ends, and the far end's identity."""
    zone_key_ = resolver.zone(F.col("zone"))
    facts = _facts(subjects)
    zoned = subjects.where(F.col("kind").isin("asset", "datastore") & (F.col("zone") != "")).select(
        F.lit("IN_ZONE").alias("edge_type"), F.col("node").alias("src"), node_id("ZONE", zone_key_).alias("dst"),
        F.lit("ZONE").alias("end_type"), zone_key_.alias("end_key"), node_id("ZONE", zone_key_).alias("end_id"), *facts)
    hosted = subjects.where(F.col("host_id").isNotNull()).select(
        F.lit("HOSTS").alias("edge_type"), F.col("host_id").alias("src"), F.col("node").alias("dst"),
        F.lit("ASSET").alias("end_type"), F.col("host_key").alias("end_key"), F.col("host_id").alias("end_id"), *facts)
    group_key = F.to_json(F.struct(F.col("group").alias("principal")))
    member = subjects.where(F.col("kind") == "identity").withColumn("group", F.explode("member_of")).select(
        F.lit("MEMBER_OF").alias("edge_type"), F.col("node").alias("src"), node_id("IDENTITY", group_key).alias("dst"),
        F.lit("IDENTITY").alias("end_type"), group_key.alias("end_key"), node_id("IDENTITY", group_key).alias("end_id"), *facts)
    both = zoned.unionByName(hosted).unionByName(member)
    return both.withColumn("edge", edge_id(F.col("edge_type"), F.col("src"), F.col("dst"), F.col("context")))


def assertions_from(rows: DataFrame, kind: str, target: Column, value_json: Column) -> DataFrame:
    """Assertions with content-derived ids from rows that carry the fact columns."""
    depth = F.col("inferred_depth") if "inferred_depth" in rows.columns else F.lit(0)
    ttl = F.col("ttl") if "ttl" in rows.columns else F.lit(None).cast("double")
    shaped = rows.select(
        F.lit(kind).alias("target_kind"), target.alias("target_id"), value_json.alias("value_json"), "provenance", "confidence", "source",
        canonical_context(F.col("context")).alias("context"), "valid_from", "valid_to", F.coalesce("observed_at", "valid_from").alias("observed_at"),
        F.array_sort("evidence").alias("evidence"), depth.alias("inferred_depth"), ttl.alias("ttl"),
    )
    payload = F.to_json(F.struct(*sorted(shaped.columns)))
    return shaped.select(content_id("assert", payload).alias("id"), "*")


def assert_nodes(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Assertions about registered nodes. ``facts`` has ``node``, ``value_json`` and the fact columns."""
    own = facts.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return assertions_from(own, "node", F.col("node"), canonical_json(F.col("value_json")))


def assert_edges(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Assertions about registered edges, in the edge's own context. ``facts`` has ``edge``, ``value_json`` and the fact columns."""
    own = facts.drop("context").join(edges.select(F.col("id").alias("edge"), "context"), "edge")
    return assertions_from(own, "edge", F.col("edge"), canonical_json(F.col("value_json")))


def _once(df: DataFrame, dedup: Callable[[Column], Column] | None) -> DataFrame:
    """One row per id, or per bucket of the id; equal ids have equal content."""
    if dedup is None:
        return df.dropDuplicates(["id"])
    names = df.columns
    return df.groupBy(dedup(F.col("id")).alias("_bucket")).agg(F.min_by(F.struct(*names), F.col("id")).alias("r")).select("r.*")


@dataclass
class Built:
    graph: Graph
    events: DataFrame


def build_graph(
    observations: DataFrame, resolver: Resolver = Resolver(), dedup: Callable[[Column], Column] | None = None, fold_metadata: bool = False,
) -> Built:
    """Build from valid observations (see ``split_valid``); the order and repetition of rows do not matter.

    A zone, host or group that is only named becomes a node without an assertion, hence is not live.
    """
    rows = with_defaults(observations)
    subjects = _subjects(rows, resolver, fold_metadata)
    relations = _relations(subjects, resolver)
    own = subjects.select(F.col("node").alias("id"), "type", "key_json")
    ends = relations.select(F.col("end_id").alias("id"), F.col("end_type").alias("type"), F.col("end_key").alias("key_json"))
    edges = relations.select(F.col("edge").alias("id"), F.col("edge_type").alias("type"), "src", "dst", "context")
    about_nodes = assertions_from(subjects, "node", F.col("node"), F.col("value_json"))
    about_edges = assertions_from(relations, "edge", F.col("edge"), F.lit('{"exists":true}'))
    return Built(
        Graph(_once(own.unionByName(ends), dedup), _once(edges, dedup), _once(about_nodes.unionByName(about_edges), dedup)),
        discovery_events(subjects, relations),
    )


def discovery_events(subjects: DataFrame, relations: DataFrame) -> DataFrame:
    """One event per observed node and per observed relation."""
    kinds = F.create_map(*[F.lit(x) for pair in DISCOVERY_EVENT.items() for x in pair])
    nodes = subjects.select(
        kinds[F.col("type")].alias("event_type"), F.col("observed_at").alias("timestamp"), "source", "confidence", "evidence",
        F.array("node").alias("affected_entities"), F.to_json(F.struct("context", F.col("type").alias("node_type"))).alias("metadata_json"))
    links = relations.select(
        F.lit("RELATIONSHIP_OBSERVED").alias("event_type"), F.col("observed_at").alias("timestamp"), "source", "confidence", "evidence",
        F.array_sort(F.array("edge", "src", "dst")).alias("affected_entities"), F.to_json(F.struct("context", "edge_type")).alias("metadata_json"))
    every = nodes.unionByName(links)
    payload = F.to_json(F.struct(*sorted(every.columns)))
    return every.select(content_id("event", payload).alias("id"), "*").dropDuplicates(["id"])
