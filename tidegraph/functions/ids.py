"""Content-derived identifiers and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegraph.model import DEFAULT_CONTEXT


def canonical_json(text: Column) -> Column:
    """Re-serialise a JSON text with sorted object keys; NULL where it does not parse."""
    return F.to_json(F.try_parse_json(text))


def canonical_context(context: Column) -> Column:
    """A label stays as it is, a missing context becomes the default one."""
    return F.coalesce(context, F.lit(DEFAULT_CONTEXT))


def canonical_map_context(context: Column) -> Column:
    """A mapping becomes JSON with sorted keys, so that equal mappings are the same context."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(context)))
    return F.coalesce(F.to_json(ordered), F.lit(DEFAULT_CONTEXT))


def content_id(prefix: str, payload: Column) -> Column:
    """``<prefix>_`` and the first 32 hex digits of the payload text's SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(payload, 256), 1, 32))


def node_id(node_type: Column | str, key_json: Column) -> Column:
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return content_id("node", F.concat(F.lit('{"key":'), key_json, F.lit(',"type":"'), kind, F.lit('"}')))


def edge_id(edge_type: Column | str, src: Column, dst: Column, context: Column) -> Column:
    kind = F.lit(edge_type) if isinstance(edge_type, str) else edge_type
    payload = F.struct(
        context.alias("context"), dst.alias("dst"), src.alias("src"), kind.alias("type")
    )
    return content_id("edge", F.to_json(payload))


def finding_id(prefix: str, entity: Column, context: str, as_of: float, finding_type: Column | None = None) -> Column:
    parts = [F.lit(repr(float(as_of))).alias("as_of"), F.lit(context).alias("context"), entity.alias("entity_id")]
    if finding_type is not None:
        parts.append(finding_type.alias("finding_type"))
    return content_id(prefix, F.to_json(F.struct(*parts)))
