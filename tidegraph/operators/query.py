"""Entity scans, filters, sorting, paging and text search on a view."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.functions import attributes as A
from tidegraph.functions.bands import provenance_name, validation_state
from tidegraph.model import EDGE_TYPES, INFERRED, NODE_TYPES
from tidegraph.operators.topology import connected_to
from tidegraph.plans.ranking import page
from tidegraph.plans.resolve import history, point_lookup
from tidegraph.plans.view import Graph, View

# Fixed values -------------------------------------------------------------
KINDS = {"ASSETS": "ASSET", "SERVICES": "SERVICE", "IDENTITIES": "IDENTITY", "DATASTORES": "DATASTORE", "ZONES": "ZONE"}
# --------------------------------------------------------------------------

Value = str | int | float | bool


@dataclass(frozen=True)
class Condition:
    """``field op value``, with op one of = != > >= < <= IN CONTAINS."""

    field: str
    op: str
    value: Value | list[Value]


def flag(field: str) -> Condition:
    """A field that is true."""
    return Condition(field, "=", True)


class _Field:
    """A field of a node: confidence, id, or an attribute by its lower-case name."""

    def __init__(self, name: str):
        self.name = name.lower()

    def _item(self) -> Column:
        return F.col("_bag")[self.name]

    def kind(self) -> Column:
        if self.name == "confidence":
            return F.lit("DOUBLE")
        return F.lit("STRING") if self.name == "id" else F.schema_of_variant(self._item())

    def text(self) -> Column:
        return F.col(self.name).cast("string") if self.name in ("confidence", "id") else F.try_variant_get(self._item(), "$", "string")

    def number(self) -> Column:
        """The value as a number where it reads as one."""
        if self.name == "confidence":
            return F.col("confidence")
        if self.name == "id":
            return F.col("id").try_cast("double")
        return F.try_variant_get(self._item(), "$", "double")


def _equals(field: _Field, value: Value) -> Column:
    """Typed equality: 443 equals 443.0 but not "443"; true equals 1."""
    k = field.kind()
    if isinstance(value, bool):
        truth = F.when(k == "BOOLEAN", field.text() == str(value).lower())
        return truth.when(A.is_numeric(k), field.number() == float(value)).otherwise(False)
    if isinstance(value, (int, float)):
        as_number = F.when(A.is_numeric(k), field.number() == float(value))
        return as_number.when(k == "BOOLEAN", F.when(field.text() == "true", 1.0).otherwise(0.0) == float(value)).otherwise(False)
    return F.when(k == "STRING", field.text() == value).otherwise(False)


def _as_float(value: Value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _condition(c: Condition) -> Column:
    field = _Field(c.field)
    there = field.kind().isNotNull() & (field.kind() != "VOID")
    if c.op == "=":
        test = _equals(field, c.value)
    elif c.op == "!=":
        test = ~_equals(field, c.value)
    elif c.op in (">", ">=", "<", "<="):
        bound, actual = _as_float(c.value), F.when(
            field.kind() == "BOOLEAN", F.when(field.text() == "true", 1.0).otherwise(0.0)).otherwise(field.number())
        if bound is None:
            return F.lit(False)
        test = {">": actual > bound, ">=": actual >= bound, "<": actual < bound, "<=": actual <= bound}[c.op]
    elif c.op == "IN":
        test = reduce(Column.__or__, [_equals(field, v) for v in c.value], F.lit(False))
    elif c.op == "CONTAINS":
        test = F.contains(F.lower(field.text()), F.lit(str(c.value).lower()))
    else:
        raise ValueError(f"unknown operator {c.op!r}")
    return F.coalesce(there & test, F.lit(False))


def predicate(where: list[Condition | str]) -> Column:
    """Conditions joined by "AND" / "OR" words, evaluated from left to right without precedence.

    Adjacent conditions without a word between them are ANDed.
    """
    out, word = F.lit(True), "AND"
    for part in where:
        if isinstance(part, str):
            word = part.upper()
            if word not in ("AND", "OR"):
                raise ValueError(f"unknown connective {part!r}")
            continue
        test = _condition(part)
        out, word = (out | test if word == "OR" else out & test), "AND"
    return out


def find_entities(
    view: View, kind: str, where: list[Condition | str] = (), connected: str | None = None, depth: int = 1,
    order_by: str | None = None, descending: bool = False, limit: int | None = None,
) -> DataFrame:
    """Live nodes of a kind that satisfy the conditions: id, type, value_json, confidence.

    ``connected`` keeps nodes within ``depth`` undirected steps of a node. All rows are returned, or the first ``limit``, by
    id unless ``order_by`` names a field (numbers before texts, missing last).
    """
    if depth < 1:
        raise ValueError("depth must be >= 1")
    if limit is not None and limit < 0:
        raise ValueError("limit must be >= 0")
    rows = view.of_type(KINDS[kind.upper()]).select("id", "type", "value_json", "confidence")
    fields = {c.field.lower() for c in where if isinstance(c, Condition)} | ({order_by.lower()} if order_by else set())
    if fields - {"id", "confidence"}:
        rows = rows.withColumn("_bag", _bag_of(sorted(fields - {"id", "confidence"})))
    rows = rows.where(predicate(list(where)))
    if connected is not None:
        rows = rows.join(connected_to(view, connected, depth).select("id"), "id", "left_semi")
    order = [F.col("id").asc()]
    if order_by is not None:
        field = _Field(order_by)
        number, text = field.number(), field.text()
        text = F.when(number.isNull(), text)
        order = ([number.desc_nulls_last(), text.desc_nulls_last()] if descending else [number.asc_nulls_last(), text.asc_nulls_last()]) + order
    rows = rows.orderBy(*order)
    return (rows if limit is None else rows.limit(limit)).select("id", "type", "value_json", "confidence")


def _bag_of(fields: list[str]) -> Column:
    """The named attributes as a struct of variants; a key in other case serves if the exact one is absent."""
    whole = F.try_parse_json("value_json")
    keys = F.json_object_keys("value_json")

    def value(name: str) -> Column:
        exact = A.item(whole, name)
        other = F.get(F.filter(keys, lambda k: F.lower(k) == name), F.lit(0))
        loose = F.try_variant_get(whole, F.concat(F.lit('$["'), other, F.lit('"]')), "variant")
        return F.coalesce(exact, loose).alias(name)

    return F.struct(*[value(f) for f in fields])


def entity_records(view: View, kind: str | None = None) -> DataFrame:
    """Resolved records of live nodes; their evidence is ``entity_evidence``."""
    rows = view.nodes if kind is None else view.of_type(KINDS[kind.upper()])
    return rows.select(
        F.col("id").alias("entity_id"), F.col("type").alias("node_type"), "value_json", "confidence", provenance_name(F.col("provenance")).alias("provenance"),
        validation_state(F.col("confidence"), F.col("provenance") == INFERRED).alias("validation_state"),
        "valid_from", F.lit(view.as_of).alias("as_of"), F.lit(view.context).alias("context"),
    )


def entity_evidence(view: View, kind: str | None = None) -> DataFrame:
    """Evidence of live nodes, one row per reference."""
    rows = view.nodes if kind is None else view.of_type(KINDS[kind.upper()])
    wanted = rows.select(F.lit("node").alias("target_kind"), F.col("id").alias("target_id"))
    return view.evidence("node", wanted).select(F.col("target_id").alias("entity_id"), "ref")


def _known(kind: str | None, allowed: tuple[str, ...]) -> str | None:
    if kind is not None and kind.upper() not in allowed:
        raise ValueError(f"unknown type {kind!r}, one of {allowed}")
    return None if kind is None else kind.upper()


def list_nodes(view: View, node_type: str | None = None, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of the live nodes by id, and the number of all of them."""
    kind = _known(node_type, NODE_TYPES)
    rows = view.nodes if kind is None else view.of_type(kind)
    rows = rows.select("id", "type", "value_json", "confidence", provenance_name(F.col("provenance")).alias("provenance"), "valid_from")
    return page(rows, [F.col("id").asc()], offset, limit), rows.agg(F.count("*").alias("total"))


def list_edges(view: View, edge_type: str | None = None, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of the live edges by id, and the number of all of them."""
    kind = _known(edge_type, EDGE_TYPES)
    rows = view.edges if kind is None else view.links(kind)
    rows = rows.select("id", "type", "src", "dst", F.lit(view.context).alias("context"), "confidence", provenance_name(F.col("provenance")).alias("provenance"), "valid_from")
    return page(rows, [F.col("id").asc()], offset, limit), rows.agg(F.count("*").alias("total"))


def node_detail(graph: Graph, node_id: str, context: str = "default", as_of: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Identity, resolved state and assertion history of one node."""
    return graph.nodes.where(F.col("id") == node_id), point_lookup(graph.points(), node_id, context, as_of, "node"), history(graph.points(), node_id, context, "node")


def edge_detail(graph: Graph, edge_id: str, context: str = "default", as_of: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Identity, resolved state and assertion history of one edge."""
    return graph.edges.where(F.col("id") == edge_id), point_lookup(graph.points(), edge_id, context, as_of, "edge"), history(graph.points(), edge_id, context, "edge")


def edge_trace(view: View, edge_id: str) -> DataFrame:
    """Where an edge comes from: ends, confidence, tier, and per row one source with one reference."""
    from tidegraph.plans.resolve import applicable
    rows = applicable(view.points.where(F.col("target_id") == edge_id), view.as_of, view.context, "edge")
    refs = rows.select(F.col("target_id").alias("id"), F.col("source").alias("from_source"), F.explode_outer("evidence").alias("ref")).distinct()
    return view.edges.where(F.col("id") == edge_id).join(refs, "id").select(
        "id", F.col("src").alias("source"), F.col("dst").alias("target"), "confidence", provenance_name(F.col("provenance")).alias("tier"),
        F.col("valid_from").alias("observed_at"), "from_source", "ref",
    )


def resolved_graph(view: View) -> DataFrame:
    """Live nodes and edges in one table."""
    nodes = view.nodes.select(F.lit("node").alias("target_kind"), "id", "type", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"),
                              "value_json", "confidence", provenance_name(F.col("provenance")).alias("provenance"), "valid_from")
    edges = view.edges.select(F.lit("edge").alias("target_kind"), "id", "type", "src", "dst", "value_json", "confidence", provenance_name(F.col("provenance")).alias("provenance"), "valid_from")
    return nodes.unionByName(edges)


def resolved_evidence(view: View) -> DataFrame:
    """Evidence of all live nodes and edges, one row per reference: (target_kind, id, ref)."""
    def targets(kind: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(kind).alias("target_kind"), F.col("id").alias("target_id"))

    refs = view.evidence(wanted=targets("node", view.nodes).unionByName(targets("edge", view.edges)))
    return refs.select("target_kind", F.col("target_id").alias("id"), "ref")


def _top_level(value_json: str) -> Column:
    """Keys and values (as text) of a JSON object."""
    pairs = F.from_json(value_json, "map<string,string>")
    return F.concat(F.map_keys(pairs), F.map_values(pairs))


def search_graph(view: View, query: str) -> DataFrame:
    """Nodes and edges with the text in an id, type, end, key value, or attribute name or value."""
    if not query.strip():
        raise ValueError("query must not be empty")
    needle = F.lit(query.lower())

    def hit(parts: Column) -> Column:
        return F.exists(parts, lambda x: F.contains(F.lower(F.coalesce(x, F.lit("none"))), needle))

    keyed = F.map_values(F.from_json("key_json", "map<string,string>"))
    empty = F.array().cast("array<string>")
    nodes = view.nodes.where(hit(F.concat(F.array("id", "type"), F.coalesce(keyed, empty), F.coalesce(_top_level("value_json"), empty))))
    edges = view.edges.where(hit(F.array("id", "type", "src", "dst", F.lit(view.context))))
    return nodes.select(F.lit("node").alias("target_kind"), "id", "type", "confidence").unionByName(edges.select(F.lit("edge").alias("target_kind"), "id", "type", "confidence"))


def search_values(view: View, query: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with the text in the id or anywhere in the value: all of them or the first ``limit`` by id, and their number."""
    needle = F.lit(query.lower())
    hits = view.nodes.where(F.contains(F.lower("value_json"), needle) | F.contains(F.lower("id"), needle)).select("id", "type", "value_json")
    return hits if limit is None else hits.orderBy("id").limit(limit), hits.agg(F.count("*").alias("count"))


def search_everything(view: View, query: str, least: int = 1) -> DataFrame:
    """Assets, recommendations and compliance entries that contain the text: (section, id, label, match_field, type).

    An asset matches by its id (no match_field) or else by its first attribute that does, in stored order; only assets have
    a type. Texts shorter than ``least`` characters find nothing.
    """
    from tidegraph.operators.rules import compliance, control_status, recommendations
    needle = F.lit(query.lower())

    def has(c: str) -> Column:
        return F.contains(F.lower(c), needle)

    pairs = F.map_entries(F.from_json("value_json", "map<string,variant>"))
    texts = F.filter(pairs, lambda e: (F.schema_of_variant(e["value"]) == "STRING") & F.contains(F.lower(F.try_variant_get(e["value"], "$", "string")), needle))
    field = F.when(~has("id"), F.get(texts, F.lit(0))["key"])
    named = view.attributes().select("id", "name")
    nodes = view.nodes.withColumn("match_field", field).where(has("id") | F.col("match_field").isNotNull()).join(named, "id").select(
        F.lit("assets").alias("section"), "id", F.col("name").alias("label"), "match_field", "type")
    none = [F.lit(None).cast("string").alias(c) for c in ("match_field", "type")]
    recs = recommendations(view).where(has("title") | has("description")).select(F.lit("recommendations").alias("section"), "id", F.col("title").alias("label"), *none)
    scores = compliance(view).where(has("framework")).select(F.lit("compliance").alias("section"), F.col("framework").alias("id"), F.col("score").cast("string").alias("label"), *none)
    failed = control_status(view).where(~F.col("passed") & ~has("framework") & (has("control_title") | has("control_id"))).select(
        F.lit("compliance").alias("section"), F.col("control_id").alias("id"), F.col("control_title").alias("label"), *none)
    out = nodes.unionByName(recs).unionByName(scores).unionByName(failed)
    return out if len(query.strip()) >= least else out.where(F.lit(False))
