"""Searches that start at single nodes.

Every edge is stored twice, from each of its ends, in the order of the node it is seen from. While a set of nodes is short it
is a list on the driver, and the scan gets it as a pushed-down filter: a step opens only the pages that can hold one of them, and
is one job. A set of more than ``listed`` nodes is a staged table and is joined; the rows are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.plans.expand import union
from tidegraph.session import stage, unstage

LISTED = 1000  # nodes of a set that is handed to the scan as a list


def adjacent(edges: DataFrame) -> DataFrame:
    """(node, way, next, edge_id, edge_type, confidence): ``way`` is out at an edge's start and in at its end. Stored by node; a node
    with very many edges covers several files."""
    rest = [F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), "confidence"]
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("way"), F.col("dst").alias("next"), *rest)
    into = edges.select(F.col("dst").alias("node"), F.lit("in").alias("way"), F.col("src").alias("next"), *rest)
    order = ["node", "edge_id"]
    return stage(out.unionByName(into).repartitionByRange(*order).sortWithinPartitions(*order), "adjacent")


@dataclass
class Nodes:
    """Rows with a distinct ``node`` each: on the driver if ``rows`` is set, else in ``table``."""

    table: DataFrame
    rows: dict[str, tuple] | None
    size: int

    def among(self, column: str) -> Column | None:
        """Whether the column is one of these nodes, as a filter; None if there are too many for a list."""
        return None if self.rows is None else F.col(column).isin(list(self.rows))

    def of(self, links: DataFrame, column: str = "node") -> DataFrame:
        """The links whose ``column`` is one of these nodes."""
        short = self.among(column)
        if short is not None:
            return links.where(short)
        return links.join(self.table.select(F.col("node").alias(column)), column, "left_semi")

    def get(self, node: str) -> tuple:
        if self.rows is not None:
            return self.rows[node]
        return tuple(self.table.where(F.col("node") == node).first())


def gather(rows: DataFrame, listed: int, short: bool = True) -> Nodes:
    """A set from rows with distinct nodes. ``short``: it is expected to be; at most ``listed`` + 1 rows come to the driver."""
    if not short:
        rows = stage(rows, "nodes")
    first = rows.limit(listed + 1).toArrow()
    if first.num_rows > listed:
        table = stage(rows, "nodes") if short else rows
        return Nodes(table, None, table.count())
    if not short:
        unstage(rows)
    each = zip(*(first.column(c).to_pylist() for c in rows.columns))
    at = rows.columns.index("node")
    return Nodes(rows.sparkSession.createDataFrame(first, rows.schema), {r[at]: r for r in each}, first.num_rows)


@dataclass
class Ball:
    """Levels of nodes around a start over the links of one ``way``, or of both if it is None.

    A level's rows are node, edge_id, next, confidence: the edge with the smallest id by which it touches the level before.
    """

    links: DataFrame
    way: str | None
    listed: int
    levels: list[Nodes] = field(default_factory=list)

    @property
    def last(self) -> Nodes:
        return self.levels[-1]

    @property
    def size(self) -> int:
        return sum(s.size for s in self.levels)

    def begin(self, starts: DataFrame) -> Ball:
        """Level 0: the nodes of ``starts`` (column ``node``)."""
        none = F.lit(None).cast("string")
        self.levels = [gather(starts.select("node", none.alias("edge_id"), none.alias("next"), F.lit(1.0).alias("confidence")), self.listed)]
        return self

    def grow(self) -> Nodes:
        """Add the next level and return it."""
        before = self.last
        fresh = touching(before, self.links if self.way is None else self.links.where(F.col("way") == self.way))
        if self.size <= self.listed:
            for level in self.levels:
                fresh = fresh.where(~level.among("node")) if level.rows else fresh
        else:
            fresh = fresh.join(union([s.table.select("node") for s in self.levels]), "node", "left_anti")
        self.levels.append(gather(fresh, self.listed, before.rows is not None))
        return self.last


def touching(nodes: Nodes, links: DataFrame) -> DataFrame:
    """The other ends of the links of ``nodes``, each with its link of the smallest id: node, edge_id, next, confidence.

    ``next`` is the end in ``nodes``.
    """
    link = F.struct("edge_id", F.col("node").alias("next"), "confidence")
    found = nodes.of(links).groupBy(F.col("next").alias("other")).agg(F.min_by(link, F.col("edge_id")).alias("link"))
    return found.select(F.col("other").alias("node"), "link.edge_id", "link.next", "link.confidence")


def path(links: DataFrame, source: DataFrame, target: DataFrame, listed: int = LISTED) -> tuple[list[str], list[str], float] | None:
    """Nodes, edge ids and least confidence of the shortest directed path; of several, the one with the smallest edge ids in order.

    ``source`` and ``target`` have at most one row each. The smaller end of two balls grows until they touch. From there
    the nodes that lie on a shortest path are followed back to the source, and each keeps its smallest edge towards the target, so that
    the path is a walk along these edges. None if there is no path.
    """
    ahead, back = Ball(links, "out", listed).begin(source), Ball(links, "in", listed).begin(target)
    while ahead.last.size and back.last.size:
        met = gather(ahead.last.of(back.last.table), listed, ahead.last.rows is not None or back.last.rows is not None)
        if met.size:
            break
        (ahead if ahead.last.size <= back.last.size else back).grow()
    else:
        return None
    steps: list[Nodes] = []
    on = met
    for level in reversed(ahead.levels[:-1]):
        on = gather(level.of(touching(on, links.where(F.col("way") == "in"))), listed, on.rows is not None or level.rows is not None)
        steps.insert(0, on)
    steps += reversed(back.levels[1:])
    node = source.first()["node"]
    nodes, edges, weakest = [node], [], 1.0
    for level in steps:
        _, edge, node, confidence = level.get(node)
        nodes.append(node)
        edges.append(edge)
        weakest = min(weakest, confidence)
    return nodes, edges, weakest
