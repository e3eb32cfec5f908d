"""Table schemas and fixed vocabularies of the temporal graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------
NODE_TYPES = ("ASSET", "SERVICE", "IDENTITY", "CREDENTIAL", "DATASTORE", "ZONE")
EDGE_TYPES = (
    "HOSTS", "IN_ZONE", "RESOLVES_TO", "CONNECTS_TO", "DEPENDS_ON", "AUTHENTICATES_TO",
    "HAS_PERMISSION", "ASSUMES_ROLE", "MEMBER_OF", "TRUSTS",
)
DEPENDENCY_TYPES = ("DEPENDS_ON", "CONNECTS_TO", "AUTHENTICATES_TO", "HAS_PERMISSION", "TRUSTS")
PROVENANCE_NAMES = ("UNKNOWN", "INFERRED", "VERIFIED", "OBSERVED")
UNKNOWN, INFERRED, VERIFIED, OBSERVED = range(4)
EVENT_TYPES = (
    "ASSET_DISCOVERED", "SERVICE_DETECTED", "IDENTITY_FOUND", "DATASTORE_IDENTIFIED",
    "ZONE_DISCOVERED", "RELATIONSHIP_OBSERVED",
)
DISCOVERY_EVENT = {
    "ASSET": "ASSET_DISCOVERED", "SERVICE": "SERVICE_DETECTED", "IDENTITY": "IDENTITY_FOUND",
    "DATASTORE": "DATASTORE_IDENTIFIED", "ZONE": "ZONE_DISCOVERED",
}
DEFAULT_CONTEXT = "default"
SCHEMA_VERSION = 1
DAY = 86400.0
# --------------------------------------------------------------------------

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Schema of a "name type, name type" text; made without a session, unlike ``StructType.fromDDL``."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


NODES = _schema("id string, type string, key_json string")

EDGES = _schema("id string, type string, src string, dst string, context string")

ASSERTIONS = _schema(
    "id string, target_kind string, target_id string, value_json string, provenance int, "
    "confidence double, source string, context string, valid_from double, valid_to double, "
    "observed_at double, evidence array<string>, inferred_depth int, ttl double"
)

EVENTS = _schema(
    "id string, event_type string, timestamp double, source string, confidence double, "
    "evidence array<string>, affected_entities array<string>, metadata_json string"
)

OBSERVATIONS = _schema(
    "kind string, source string, evidence array<string>, observed_at double, confidence double, "
    "provenance int, context string, valid_from double, valid_to double, attributes_json string, "
    "mac string, cloud_id string, hostname string, ip string, zone string, port int, "
    "product_signature string, metadata_json string, principal string, sid string, iam_id string, "
    "email string, identity_type string, member_of array<string>, name string, host_mac string, "
    "host_cloud_id string, host_hostname string, host_ip string"
)

SNAPSHOT_META = _schema(
    "name string, created_at double, node_count bigint, edge_count bigint, assertion_count bigint, "
    "content_hash string, schema_version int"
)
