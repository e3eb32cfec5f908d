"""The resolved graph at a time in a context, and the derived tables operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from threading import Lock
from typing import TypeVar

from pyspark.sql import DataFrame, functions as F

from tidegraph.functions import attributes as A
from tidegraph.model import DEFAULT_CONTEXT, DEPENDENCY_TYPES, INFERRED, UNKNOWN
from tidegraph.plans.resolve import States, change_counts, evidence, in_scope, moment
from tidegraph.session import stage, together, unstage

T = TypeVar("T")


@dataclass
class Graph:
    """Registered identities and the assertion log.

    A stored graph also has ``by_target``, the log in an order for reads of one target, and ``counts``, numbers of assertions per
    target (context, target_kind, target_id, changes; rows of one target add up).
    """

    nodes: DataFrame
    edges: DataFrame
    assertions: DataFrame
    by_target: DataFrame | None = None
    counts: DataFrame | None = None

    def points(self) -> DataFrame:
        """The log for reads of one target."""
        return self.assertions if self.by_target is None else self.by_target

    def changes(self, context: str, kind: str) -> DataFrame:
        """(target_id, changes): assertions of each target whatever their time; from the stored counts where there are any."""
        if self.counts is None:
            return change_counts(in_scope(self.assertions, context, kind)).select("target_id", "changes")
        return in_scope(self.counts, context, kind).groupBy("target_id").agg(F.sum("changes").alias("changes"))


@dataclass
class View:
    """Live nodes and edges at ``(context, as_of)``.

    ``nodes``: id, type, key_json, value_json, provenance, confidence, source, valid_from, valid_to,
    winner, contributors, changes. ``edges``: the same with type, src, dst instead of a key, and without changes.
    ``log``: the assertions; ``points``: the same for reads of one target.
    """

    context: str
    as_of: float
    nodes: DataFrame
    edges: DataFrame
    log: DataFrame
    points: DataFrame
    _kept: dict[str, object] = field(default_factory=dict)
    _locks: dict[str, Lock] = field(default_factory=dict)

    def once(self, name: str, make: Callable[[], T]) -> T:
        """The result of ``make``, made on first use; operators may ask from several threads."""
        with self._locks.setdefault(name, Lock()):
            if name not in self._kept:
                self._kept[name] = make()
            return self._kept[name]

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table several operators read: computed and staged on first use."""
        return self.once(name, lambda: stage(build(), name))

    def has(self, name: str) -> bool:
        return name in self._kept

    def drop(self) -> None:
        """Remove the view's staged tables; what is read from them becomes unreadable."""
        unstage(self.nodes, self.edges, *[t for t in self._kept.values() if isinstance(t, DataFrame)])

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*types))

    def links(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def degrees(self) -> DataFrame:
        """Edge ends per node: parallel edges count each, a self-loop counts twice."""
        return self.keep("degrees", lambda: (
            self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
            .groupBy("id").agg(F.count("*").alias("degree"))
        ))

    def dependencies(self) -> DataFrame:
        """Distinct (consumer, provider) pairs of the dependency edges."""
        return self.keep("dependencies", lambda: (
            self.links(*DEPENDENCY_TYPES)
            .select(F.col("src").alias("consumer"), F.col("dst").alias("provider")).distinct()
        ))

    def evidence(self, kind: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """Distinct (target_kind, target_id, ref) of what applies in the view, of one kind or of the ``wanted`` targets only."""
        return evidence(self.log, self.as_of, self.context, kind, wanted).drop("context")

    def attributes(self) -> DataFrame:
        """One parsed row per live node, so that JSON is read once per view."""
        return self.keep("attributes", self._parse)

    def _parse(self) -> DataFrame:
        v = A.bag("value_json")
        port = A.number(F.col("v"), "port")
        signature = A.first_text(A.text(F.col("v"), "product_signature"), A.text(F.col("v"), "signature"))
        kind = A.text(F.col("v"), "type")
        typed = self.nodes.withColumn("v", v).withColumn("k", A.bag("key_json"))
        v = F.col("v")
        is_service = F.col("type") == "SERVICE"
        return typed.select(
            "id", "type", "confidence", "provenance", "valid_from", "changes",
            (F.col("provenance") == INFERRED).alias("inferred"),
            F.coalesce(A.text(v, "name"), F.col("id")).alias("name"),
            F.lower(F.coalesce(A.text(v, "name"), F.lit(""))).alias("folded_name"),
            F.lower(F.coalesce(A.text(F.col("k"), "name"), F.lit(""))).alias("key_name"),
            F.lower(F.coalesce(A.text(v, "classification"), F.lit(""))).alias("classification"),
            F.coalesce(A.number(v, "business_importance"), F.lit(0.0)).alias("importance"),
            A.folded_tag(v, "env", "environment").alias("env_tag"),
            A.folded_tag(v, "sensitivity", "data_classification").alias("sensitivity_tag"),
            A.tag(v, "owner:team", "team").alias("team"),
            A.tag(v, "owner:tech", "tech_owner").alias("technical"),
            A.tag(v, "owner:business", "business_owner").alias("business"),
            F.coalesce(
                A.truthy(v, "exposed") | A.truthy(v, "public") | A.truthy(v, "public_ip"), F.lit(False)
            ).alias("public_flag"),
            A.present(v, "cloud_provider").alias("has_cloud"),
            A.text(v, "cloud_provider").alias("cloud_provider"),
            F.coalesce(kind, F.lit("")).alias("kind"),
            port.alias("port"), signature.alias("signature"),
            (
                (F.col("type") == "ASSET")
                & (
                    F.coalesce(kind == "LoadBalancer", F.lit(False))
                    | F.coalesce((A.kind(v, "public") == "BOOLEAN") & (A.text(v, "public") == "true"), F.lit(False))
                    | A.present(v, "public_ip")
                )
            ).alias("internet_asset"),
            (
                is_service
                & (
                    F.coalesce(A.is_numeric(A.kind(v, "port")) & port.isin(80.0, 443.0), F.lit(False))
                    | F.coalesce(kind == "LoadBalancer", F.lit(False))
                )
            ).alias("internet_service"),
            (
                (F.col("type") == "DATASTORE")
                | (is_service & F.coalesce(signature.isin("mysql", "postgres", "redis"), F.lit(False)))
            ).alias("exposed_store"),
            F.to_json(A.item(v, "tags")).alias("tags_json"),
        )


def each_view(graph: Graph, times: list[float | None], context: str | None = None) -> Iterator[View]:
    """Views at several times, one made after the other, as each shuffles all edges; which targets are contested, and who wins them, is
    found once for all of them."""
    context = context or DEFAULT_CONTEXT
    nodes, edges = together([lambda k=k: States(graph.assertions, times, context, k) for k in ("node", "edge")])
    counts = graph.changes(context, "node")
    if len(times) > 1:
        counts = stage(counts, "change_counts")
    for n, t in enumerate(times):
        yield _view(graph, nodes.at(n), edges.at(n), counts, moment(t), context)


def open_views(graph: Graph, times: list[float | None], context: str | None = None) -> list[View]:
    return list(each_view(graph, times, context))


def _view(graph: Graph, node_states: DataFrame, edge_states: DataFrame, counts: DataFrame, as_of: float, context: str) -> View:
    def known(states: DataFrame) -> DataFrame:
        return states.where(F.col("provenance") > UNKNOWN).withColumnRenamed("target_id", "id")

    nodes = stage(graph.nodes.join(known(node_states), "id").join(counts.withColumnRenamed("target_id", "id"), "id"), "live_nodes")
    alive = nodes.select("id")
    ends = stage((  # looked up while the rows are narrow, and stored, so that these shuffles are gone before those of the states come
        graph.edges.drop("context")
        .join(alive.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ), "live_ends")
    edges = stage(ends.join(known(edge_states), "id").select(
        "id", "type", "src", "dst", "value_json", "provenance", "confidence", "source", "valid_from", "valid_to", "winner", "contributors"), "live_edges")
    unstage(ends)
    return View(context, as_of, nodes, edges, graph.assertions, graph.points())


def open_view(graph: Graph, as_of: float | None = None, context: str | None = None) -> View:
    """The view at one time; ``as_of=None`` is the latest state."""
    return open_views(graph, [as_of], context)[0]
