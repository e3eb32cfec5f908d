"""Neighbourhoods, dependency metrics, impact, blast radius and paths on a view."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegraph.functions.bands import path_severity
from tidegraph.functions.ids import finding_id
from tidegraph.model import DEPENDENCY_TYPES
from tidegraph.plans.components import capped_reach, cyclic_components, reach_counts
from tidegraph.plans.expand import make_links, reached, small_closure, union, with_ends
from tidegraph.plans.near import LISTED, Ball, adjacent, gather, path
from tidegraph.plans.view import View
from tidegraph.plans.words import Levels, word_levels
from tidegraph.session import stage

# Fixed values -------------------------------------------------------------
IMPACT_DEPTH = 3
IMPACT_WEIGHTS = {1: 1.0, 2: 0.5, 3: 0.25}
IMPACT_SCALE = 5.0
COUNTED_KINDS = ("ASSET", "SERVICE", "DATASTORE", "IDENTITY")
# --------------------------------------------------------------------------


def adjacency(view: View) -> DataFrame:
    """One row per node and incident edge end: direction ``out`` or ``in``, and the other node."""
    out = view.edges.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("id").alias("edge_id"),
                            F.col("type").alias("edge_type"), F.col("dst").alias("other"), "confidence")
    into = view.edges.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("id").alias("edge_id"),
                             F.col("type").alias("edge_type"), F.col("src").alias("other"), "confidence")
    return out.unionByName(into)


def degrees(view: View) -> DataFrame:
    """Degree of every live node, isolated ones with 0."""
    return view.nodes.select("id").join(view.degrees(), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def providers(view: View) -> DataFrame:
    """What each node depends on (id, provider)."""
    return view.dependencies().select(F.col("consumer").alias("id"), "provider")


def dependents(view: View) -> DataFrame:
    """What depends on each node (id, consumer)."""
    return view.dependencies().select(F.col("provider").alias("id"), "consumer")


def neighbourhood(view: View, node_id: str) -> DataFrame:
    """Direct providers (``up``) and dependents (``down``) of one node, with their types."""
    up = providers(view).where(F.col("id") == node_id).select(F.lit("up").alias("direction"), F.col("provider").alias("id"))
    down = dependents(view).where(F.col("id") == node_id).select(F.lit("down").alias("direction"), F.col("consumer").alias("id"))
    return up.unionByName(down).join(view.nodes.select("id", "type"), "id").select("direction", "id", "type")


def dependent_kinds(view: View) -> DataFrame:
    """Number of direct dependents per node: assets, services and datastores."""
    typed = dependents(view).join(view.nodes.select(F.col("id").alias("consumer"), "type"), "consumer")
    kind = F.col("type")
    counts = typed.groupBy("id").agg(
        F.count_if(kind == "ASSET").alias("assets"), F.count_if(kind == "SERVICE").alias("services"),
        F.count_if(kind == "DATASTORE").alias("datastores"),
    )
    return view.nodes.select("id").join(counts, "id", "left").na.fill(0)


def dependency_counts(view: View) -> DataFrame:
    """Distinct providers and dependents of every live node."""
    def build() -> DataFrame:
        up = view.dependencies().groupBy(F.col("consumer").alias("id")).agg(F.count("*").alias("upstream"))
        down = view.dependencies().groupBy(F.col("provider").alias("id")).agg(F.count("*").alias("downstream"))
        return (
            view.nodes.select("id").join(up, "id", "left").join(down, "id", "left").na.fill(0, ["upstream", "downstream"])
            .withColumn("total", F.col("upstream") + F.col("downstream"))
        )
    return view.keep("dependency_counts", build)


def dependency_metrics(view: View) -> DataFrame:
    """Counts and the dense rank of the total, the largest total first.

    Only the distinct totals are ranked (at most the square root of twice the edges) and joined back.
    """
    counts = dependency_counts(view)
    totals = counts.groupBy("total").agg(F.count("*").alias("nodes"))
    ranks = totals.select("total", F.row_number().over(Window.orderBy(F.col("total").desc())).alias("dependency_rank"))
    return counts.join(ranks, "total").select(
        finding_id("dependency", F.col("id"), view.context, view.as_of).alias("finding_id"),
        F.col("id").alias("entity_id"), F.col("upstream").alias("upstream_count"),
        F.col("downstream").alias("downstream_count"), F.col("total").alias("total_dependencies"), "dependency_rank",
    )


def dependency_evidence(view: View) -> DataFrame:
    """Distinct evidence of each node's dependency edges (entity_id, ref)."""
    ends = view.links(*DEPENDENCY_TYPES).select(F.col("id").alias("target_id"), F.explode(F.array("src", "dst")).alias("entity_id"))
    refs = view.evidence("edge", ends.select(F.lit("edge").alias("target_kind"), "target_id")).select("target_id", "ref")
    return ends.distinct().join(refs, "target_id").select("entity_id", "ref").distinct()


def _dependent_links(view: View) -> DataFrame:
    return view.dependencies().select(F.col("provider").alias("node"), F.col("consumer").alias("next"))


def impact_paths(view: View, roots: DataFrame | None = None) -> DataFrame:
    """Nodes hit when a root becomes unavailable: (entity_id, affected_id, depth), depth 1 to 3.

    ``roots`` has one column ``id``; all live nodes by default. Depth 1 is directly affected.
    """
    return _impact_levels(view, roots).pairs().select(F.col("root").alias("entity_id"), F.col("node").alias("affected_id"), "depth")


def _impact_levels(view: View, roots: DataFrame | None) -> Levels:
    starts = (view.nodes if roots is None else roots).select(F.col("id").alias("node"))
    return word_levels(starts, _dependent_links(view), IMPACT_DEPTH)


def impact_of(view: View, roots: DataFrame | None = None) -> DataFrame:
    """Per root the affected counts per depth and the impact score; the paths are counted without listing them."""
    sizes = _impact_levels(view, roots).sizes()
    counts = sizes.groupBy(F.col("node").alias("entity_id")).agg(*[F.sum(F.when(F.col("depth") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in IMPACT_WEIGHTS])
    starts = (view.nodes if roots is None else roots).select(F.col("id").alias("entity_id"))
    return starts.join(counts, "entity_id", "left").na.fill(0).select(
        "entity_id", F.col("n1").alias("directly_affected"), (F.col("n2") + F.col("n3")).alias("indirectly_affected"),
        _impact_score(F.col("n1"), F.col("n2"), F.col("n3")).alias("impact_score"),
    )


def _impact_score(n1: Column, n2: Column, n3: Column) -> Column:
    weighted = n1 * F.lit(IMPACT_WEIGHTS[1]) + n2 * F.lit(IMPACT_WEIGHTS[2]) + n3 * F.lit(IMPACT_WEIGHTS[3])
    return F.bround(F.lit(100.0) * F.least(F.lit(1.0), weighted / IMPACT_SCALE)).cast("int")


def impact_scores(view: View) -> DataFrame:
    """Impact score of every live node in time linear in the graph, whatever its hubs.

    Let ``n1``, ``n2`` and ``n3`` nodes of a depth be enough for a full score (5, 10 and 20 by the present weights). A root with
    n1 dependents is done. Of the others one whose dependent alone has n1 + n2 dependents is done as well: less the at
    most n1 known ones (the root among them) that is n2 new ones. The rest have fewer than n2 nodes at depth 2, and one of
    those with n1 + n2 - 1 + n3 dependents adds at least n3 new ones at depth 3. Only what remains is expanded, hence
    the rows per root are bounded by these numbers, and every score is exact.
    """
    n1, n2, n3 = (math.ceil(IMPACT_SCALE / IMPACT_WEIGHTS[d] - 1e-9) for d in (1, 2, 3))
    wide, wide_2 = n1 + n2, n1 + n2 - 1 + n3
    links = _dependent_links(view).where(F.col("node") != F.col("next"))
    fan = stage(links.groupBy("node").agg(F.count("*").alias("fan")), "impact_fan")  # read four times

    few = fan.where(F.col("fan") < n1).select(F.col("node").alias("root"))
    first = stage(
        links.withColumnRenamed("node", "root").join(few, "root", "left_semi")
        .join(fan.select(F.col("node").alias("next"), "fan"), "next", "left").na.fill(0, ["fan"]), "impact_1",
    )
    one = first.groupBy("root").agg(F.count("*").alias("n1"), F.max("fan").alias("widest"))
    open_1 = one.where(F.col("widest") < wide).select("root")
    step = first.join(open_1, "root", "left_semi").select("root", F.col("next").alias("node")).join(links, "node")
    known = first.select("root", "next")
    second = stage(
        step.select("root", "next").where(F.col("root") != F.col("next")).distinct().join(known, ["root", "next"], "left_anti")
        .join(fan.select(F.col("node").alias("next"), "fan"), "next", "left").na.fill(0, ["fan"]), "impact_2",
    )
    two = second.groupBy("root").agg(F.count("*").alias("n2"), F.max("fan").alias("widest_2"))
    sums = one.join(two, "root", "left").na.fill(0, ["n2", "widest_2"])
    weighted = F.col("n1") * IMPACT_WEIGHTS[1] + F.col("n2") * IMPACT_WEIGHTS[2]
    unsettled = (weighted < IMPACT_SCALE) & (F.col("widest") < wide) & (F.col("widest_2") < wide_2)
    open_2 = sums.where(unsettled).select("root")
    step = second.join(open_2, "root", "left_semi").select("root", F.col("next").alias("node")).join(links, "node")
    known = known.union(second.select("root", "next"))
    third = (
        step.select("root", "next").where(F.col("root") != F.col("next")).distinct()
        .join(known, ["root", "next"], "left_anti").groupBy("root").agg(F.count("*").alias("n3"))
    )
    small = sums.join(third, "root", "left").na.fill(0, ["n3"]).select(
        F.col("root").alias("id"),
        F.when((F.col("widest") >= wide) | (F.col("widest_2") >= wide_2), 100)
        .otherwise(_impact_score(F.col("n1"), F.col("n2"), F.col("n3"))).alias("score"),
    )
    full = fan.where(F.col("fan") >= n1).select(F.col("node").alias("id"), F.lit(100).alias("score"))
    return view.nodes.select("id").join(small.unionByName(full), "id", "left").select(
        F.col("id").alias("entity_id"), F.coalesce("score", F.lit(0)).alias("impact_score")
    )


def blast_radius(view: View, node_id: str) -> DataFrame:
    """Everything downstream of one live node: id, type, name. On a cycle the node counts itself."""
    links = _dependent_links(view)
    first = links.where(F.col("node") == node_id).select(F.col("next").alias("node"))
    found = reached(first, make_links(links)).select(F.col("node").alias("id"))
    return view.attributes().select("id", "type", "name").join(found, "id", "left_semi")


def cycles(view: View) -> DataFrame | None:
    """(node, component) of the nodes on a dependency cycle, once per view."""
    return view.once("cycles", lambda: cyclic_components(_dependent_links(view)))


def blast_counts(view: View, roots: DataFrame | None = None) -> DataFrame:
    """Exact size of the blast radius per root (column ``id``; all live nodes by default), in total
    and per kind; zones and credentials count as UNKNOWN. The table of all nodes is kept."""
    if roots is None:
        return view.keep("blast", lambda: _blast(view, view.nodes))
    if view.has("blast"):
        return blast_counts(view).join(roots.select("id"), "id", "left_semi")
    return _blast(view, roots)


def _blast(view: View, roots: DataFrame) -> DataFrame:
    kind = F.col("type")
    weights = view.nodes.select(
        F.col("id").alias("node"), F.lit(1).alias("total_impacted"),
        *[F.when(kind == k, 1).otherwise(0).alias(k.lower()) for k in COUNTED_KINDS],
        F.when(kind.isin(*COUNTED_KINDS), 0).otherwise(1).alias("unknown"),
    )
    starts = roots.select(F.col("id").alias("node"))
    counts = reach_counts(_dependent_links(view), weights, starts, cycles(view)).withColumnRenamed("node", "id")
    return starts.withColumnRenamed("node", "id").join(counts, "id", "left").na.fill(0)


def _repeated(view: View) -> DataFrame | None:
    """(node, weight) of ids that several rows of the live nodes have, which the blast radius counts each; None if there are none."""
    def find() -> DataFrame | None:
        rows = stage(view.nodes.groupBy(F.col("id").alias("node")).agg(F.count("*").alias("weight")).where("weight > 1"), "repeated")
        return None if rows.isEmpty() else rows
    return view.once("repeated", find)


def _of_roots(view: View, roots: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, total_impacted) of each root, with the rows that ``blast_counts`` has for repeated ids."""
    ids = roots.select("id")
    if _repeated(view) is not None:
        counts = ids.join(counts, "id")
    return ids.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("total_impacted"))


def blast_up_to(view: View, most: int, roots: DataFrame) -> DataFrame:
    """(id, total_impacted): size of the blast radius per root (column ``id``), counted up to ``most``."""
    counts = capped_reach(_dependent_links(view), roots.select(F.col("id").alias("node")), most, _repeated(view))
    return _of_roots(view, roots, counts.select(F.col("node").alias("id"), F.col("reach").alias("n")))


def blast_of_few(view: View, roots: DataFrame) -> DataFrame | None:
    """(id, total_impacted): exact size of the blast radius of a few roots, searched from them; None if they reach too many nodes or too far."""
    pairs = small_closure(roots.select(F.col("id").alias("root")).distinct(), make_links(with_ends(_dependent_links(view))))
    if pairs is None:
        return None
    heavy = _repeated(view)
    weighed = pairs.withColumn("weight", F.lit(1)) if heavy is None else pairs.join(heavy, "node", "left").na.fill(1, ["weight"])
    return _of_roots(view, roots, weighed.groupBy(F.col("root").alias("id")).agg(F.sum("weight").alias("n")))


def connected_to(view: View, node_id: str, depth: int = 1, listed: int = LISTED) -> DataFrame:
    """Ids within ``depth`` undirected steps of a node, without the node itself."""
    ball = _around(view, node_id, depth, None, listed)
    return _levels(ball).where(F.col("depth") > 0).select(F.col("node").alias("id"), "depth")


def _adjacent(view: View) -> DataFrame:
    return view.once("adjacent", lambda: adjacent(view.edges))


def _here(view: View, node_id: str) -> DataFrame:
    return view.nodes.where(F.col("id") == node_id).select(F.col("id").alias("node"))


def _around(view: View, center: str, depth: int, enough: int | None, listed: int) -> Ball:
    """Undirected levels around a node: ``depth`` of them, or fewer once ``enough`` nodes are known or nothing is new."""
    ball = Ball(_adjacent(view), None, listed).begin(_here(view, center))
    while len(ball.levels) <= depth and ball.last.size and (enough is None or ball.size < enough):
        ball.grow()
    return ball


def _levels(ball: Ball) -> DataFrame:
    return union([s.table.select("node", F.lit(k).alias("depth")) for k, s in enumerate(ball.levels)])


def subgraph(view: View, center: str, depth: int = 1, limit: int = 100, listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """At most ``limit`` nodes within ``depth`` undirected steps, nearest first, and the edges touching
    a node that was expanded (one nearer than ``depth``)."""
    found = _levels(_around(view, center, depth, limit, listed))
    kept = gather(found.orderBy("depth", "node").limit(limit), listed)
    nodes = view.nodes.join(kept.table.withColumnRenamed("node", "id"), "id").select("id", "type", "value_json", "depth")
    inner = gather(kept.table.where(F.col("depth") < depth), listed)
    touched = inner.of(_adjacent(view))
    out = F.col("way") == "out"
    edges = touched.select(
        F.col("edge_id").alias("id"), F.col("edge_type").alias("type"),
        F.when(out, F.col("node")).otherwise(F.col("next")).alias("src"), F.when(out, F.col("next")).otherwise(F.col("node")).alias("dst"),
    ).distinct()
    return nodes, edges


def shortest_path(view: View, source: str, target: str, listed: int = LISTED) -> DataFrame:
    """The shortest directed path, ties by the edge ids along it; no row if there is none.

    Columns source, target, nodes, edges, distance, severity, score.
    """
    found = path(_adjacent(view), _here(view, source), _here(view, target), listed)
    row = view.nodes.sparkSession.createDataFrame([] if found is None else [found], "nodes array<string>, edges array<string>, weakest double")
    return row.select(
        F.lit(source).alias("source"), F.lit(target).alias("target"), "nodes", "edges",
        F.size("edges").alias("distance"), path_severity(F.col("weakest")).alias("severity"),
        F.floor(F.col("weakest") * 100).cast("int").alias("score"),
    )


def all_paths(view: View, source: str, max_nodes: int = 5, target: str | None = None, listed: int = LISTED) -> DataFrame:
    """Every simple directed path of one edge or more from the source with at most ``max_nodes`` nodes, parallel edges apart; to
    one ``target``, or to all nodes.

    Without a target each path found is a result, and so is each of its beginnings. With one, beginnings and ends of half the
    length are met in the middle, and neither leaves the nodes that are near enough to the other end.
    """
    links, most = _adjacent(view), max_nodes - 1
    begun = _here(view, source)
    if target is None:
        out = _walks(links, begun, "out", most, None, None, listed)
    else:
        half = (most + 1) // 2
        ahead, back = Ball(links, "out", listed).begin(begun), Ball(links, "in", listed).begin(_here(view, target))
        for ball in (ahead, back):
            while len(ball.levels) <= most and ball.last.size:
                ball.grow()
        first = _walks(links, begun, "out", half, _within(back, most), target, listed)
        last = _walks(links, _here(view, target), "in", most - half, _within(ahead, most), source, listed)
        out = first.where(F.col("node") == target)
        ends = last.select(
            "node", F.reverse(F.slice("nodes", 1, F.size("nodes") - 1)).alias("rest"), F.reverse("edges").alias("more"))
        met = first.where((F.size("edges") == half) & (F.col("node") != target)).join(ends, "node").where(~F.arrays_overlap("nodes", "rest"))
        out = out.unionByName(met.select(F.lit(target).alias("node"), F.concat("nodes", "rest").alias("nodes"), F.concat("edges", "more").alias("edges")))
    return out.select(F.lit(source).alias("source"), F.col("node").alias("target"), "nodes", "edges", F.size("edges").alias("distance"))


def _within(ball: Ball, most: int) -> DataFrame:
    """(next, left): nodes of a ball, and the most edges a path may have used up when it gets to them."""
    return union([s.table.select(F.col("node").alias("next"), F.lit(most - k).alias("left")) for k, s in enumerate(ball.levels)])


def _walks(links: DataFrame, start: DataFrame, way: str, most: int, near: DataFrame | None, end: str | None, listed: int) -> DataFrame:
    """Simple paths of 1 to ``most`` edges from ``start``: node, nodes, edges. A path stops at ``end``, and goes only to nodes
    of ``near`` in time. All links are staged only for paths that end at more than ``listed`` nodes."""
    steps, ways = links.where(F.col("way") == way).select("node", "next", "edge_id"), None
    if near is not None and most > 0:
        steps = steps.join(near, "next")
    paths = start.select("node", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    found = [stage(paths.where(F.lit(False)), "paths")]
    for used in range(1, most + 1):
        open_paths = paths if end is None else paths.where(F.col("node") != end)
        ends = gather(open_paths.select("node").distinct(), listed) if ways is None else None
        if ends is not None and ends.rows is not None:
            longer = open_paths.join(ends.of(steps), "node")
        else:
            ways = ways or make_links(steps)
            longer = ways.expand(open_paths)
        longer = longer.where(~F.array_contains("nodes", F.col("next")))
        if near is not None:
            longer = longer.where(F.col("left") >= used)
        paths = stage(longer.select(
            F.col("next").alias("node"), F.array_append("nodes", F.col("next")).alias("nodes"),
            F.array_append("edges", F.col("edge_id")).alias("edges"),
        ), "paths")
        if paths.isEmpty():
            break
        found.append(paths)
    return union(found)
