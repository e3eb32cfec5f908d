"""Strongly connected components, and reach sizes over the condensed graph.

Nodes on a common cycle reach exactly the same nodes, so reach sizes are computed between components
instead of between nodes: a cycle of a million nodes is one row, not 10^12 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegraph.plans.contract import doubled, shrunk
from tidegraph.plans.expand import Seen, closure, make_links, reached, union, with_ends
from tidegraph.session import stage, together, unstage

ROOTS = 100_000  # roots whose reachable pairs are held at once


def turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("next").alias("node"), F.col("node").alias("next"))


def _around_busiest(links: DataFrame) -> DataFrame:
    """(node, component) of the component of the busiest node, usually by far the largest one."""
    ends = links.select("node", F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.select("next", F.lit(0), F.lit(1)))
    busy = ends.groupBy("node").agg((F.sum("o") * F.sum("i")).alias("weight"))
    pivot = busy.agg(F.max_by("node", F.struct("weight", "node")).alias("node"))
    pivot = stage(pivot, "pivot")
    after, before = together([lambda: reached(pivot, make_links(links)), lambda: reached(pivot, make_links(turned(links)))])
    name = pivot.first()["node"]  # one id
    return after.join(before, "node", "left_semi").select("node", F.lit(name).alias("component"))


def _largest_ancestor(links: DataFrame) -> DataFrame:
    """(node, color): the largest node id that reaches it, itself included."""
    ways = make_links(links)
    ids = links.select("node").union(links.select("next")).distinct()
    colors = stage(ids.select("node", F.col("node").alias("color")), "colors")
    changed = colors
    while True:
        offers = ways.expand(changed).groupBy(F.col("next").alias("node")).agg(F.max("color").alias("offer"))
        better = stage(
            offers.join(colors, "node").where(F.col("offer") > F.col("color")).select("node", F.col("offer").alias("color")),
            "recolored",
        )
        if better.isEmpty():
            return colors
        colors = stage(
            colors.join(better.withColumnRenamed("color", "new"), "node", "left")
            .select("node", F.coalesce("new", "color").alias("color")),
            "colors",
        )
        changed = better


def _by_color(links: DataFrame) -> DataFrame:
    """(node, component) of at least one component per color: color by largest ancestor, then walk back inside each color."""
    colors = _largest_ancestor(links)
    inside = (
        links.join(colors, "node")
        .join(colors.select(F.col("node").alias("next"), F.col("color").alias("next_color")), "next")
        .where(F.col("color") == F.col("next_color"))
    )
    back = make_links(turned(inside))
    frontier = stage(colors.where(F.col("node") == F.col("color")), "roots")
    seen = Seen(["node"])
    while seen.add(frontier):
        found = back.expand(frontier).select(F.col("next").alias("node"), "color").distinct()
        frontier = stage(seen.without(found), "back")
    return seen.all().withColumnRenamed("color", "component")


def cyclic_components(links: DataFrame) -> DataFrame | None:
    """(node, component) of every node on a cycle of two or more nodes; None if there is none.

    Trees and runs are taken away first and after each find, so the searches walk what branches both ways. A node of a run lies
    on a cycle if both of its ends lie in one component, or are one node; runs are put back in the reverse order.
    """
    rest, turns, _ = shrunk(links)
    parts = []
    while not rest.isEmpty():
        find = _by_color if parts else _around_busiest
        done = stage(find(rest), "component")
        parts.append(done)
        rest, more, _ = shrunk(
            rest.join(done.select("node"), "node", "left_anti")
            .join(done.select(F.col("node").alias("next")), "next", "left_anti")
        )
        turns += more
    parts += [t.rings for t in turns]
    if not parts:
        return None
    found = union(parts)
    for turn in reversed(turns):
        loose = turn.loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
        found = stage(found.unionByName(loose), "component")
        of_start, of_end = found.toDF("start", "component"), found.toDF("end", "other")
        inside = turn.runs.join(of_start, "start").join(of_end, "end").where("component = other").select("node", "component")
        found = stage(found.unionByName(inside), "component")
    several = found.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    found = stage(found.join(several.select("component"), "component", "left_semi").select("node", "component"), "cyclic")
    return None if found.isEmpty() else found


def reach_counts(links: DataFrame, weights: DataFrame, roots: DataFrame, components: DataFrame | None, roots_at_once: int = ROOTS) -> DataFrame:
    """Number of nodes each root reaches over one or more links, per weight column.

    ``links``: distinct (node, next); ``weights``: node and numeric columns (a 1 and kind flags);
    ``roots``: one column ``node``; ``components``: of ``cyclic_components(links)``. Roots that reach
    nothing are left out.
    """
    names = [c for c in weights.columns if c != "node"]
    loops = links.where(F.col("node") == F.col("next")).select("node")
    if components is None:
        flat, tagged, wanted = links, weights, roots.select("node", F.col("node").alias("component"))
        own = loops.withColumnRenamed("node", "component")
    else:
        def component_of(df: DataFrame, column: str, out: str) -> DataFrame:
            side = components.select(F.col("node").alias(column), F.col("component").alias("_c"))
            return df.join(side, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")

        flat = component_of(component_of(links, "node", "a"), "next", "b")
        flat = flat.where(F.col("a") != F.col("b")).select(F.col("a").alias("node"), F.col("b").alias("next")).distinct()
        tagged = component_of(weights, "node", "component").groupBy("component").agg(
            *[F.sum(c).alias(c) for c in names]
        ).withColumnRenamed("component", "node")
        wanted = component_of(roots.select("node"), "node", "component")
        own = components.select("component").union(loops.select(F.col("node").alias("component"))).distinct()
    flat, tagged, wanted = together([
        lambda: stage(flat.where(F.col("node") != F.col("next")), "flat"), lambda: stage(tagged, "tagged"), lambda: stage(wanted, "wanted")])
    asked = wanted.select(F.col("component").alias("node")).distinct()
    counted = acyclic_reach(flat, tagged, asked, roots_at_once)
    itself = own.join(asked.withColumnRenamed("node", "component"), "component", "left_semi").select(F.col("component").alias("node"))
    sums = counted.unionByName(itself.join(tagged, "node")).groupBy(F.col("node").alias("component")).agg(*[F.sum(c).alias(c) for c in names])
    return wanted.join(sums, "component").select("node", *names)


def acyclic_reach(links: DataFrame, weights: DataFrame, roots: DataFrame, roots_at_once: int = ROOTS) -> DataFrame:
    """Sums of the weight columns over what each root (column ``node``) reaches in a graph without cycles; staged.

    A node with one successor reaches that and what it reaches: its sums come by pointer doubling, up to the first node that
    branches. Only for those, pairs are listed, over a graph in which runs of nodes with one predecessor and one successor
    are one node, and for ``roots_at_once`` roots at a time, whose pairs are summed and dropped before the next ones.
    Roots that reach nothing are left out.
    """
    names = [c for c in weights.columns if c != "node"]
    degree = links.groupBy("node").agg(F.count("*").alias("n"), F.min("next").alias("next"))
    single = degree.where("n = 1").select("node", "next")
    stretch = single.join(weights.withColumnRenamed("node", "next"), "next").select("node", "next", *names)
    ends, _ = doubled(stretch, {c: lambda a, b: a + b for c in names})
    mine = stage(roots.join(ends.drop("open").withColumnRenamed("next", "end"), "node", "left"), "on_the_way")
    # what branches: asked for itself, or at the end of a way that is
    branching = degree.where("n > 1").select(F.col("node").alias("root"))
    sought = mine.select(F.coalesce("end", "node").alias("root")).distinct().join(branching, "root", "left_semi")
    sought = stage(sought.withColumn("turn", F.xxhash64("root")), "sought")
    count = sought.count()
    totals = None
    if count:
        before = links.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
        inner = stage(single.join(before, "node", "left_semi"), "inner")
        # a run is named by its last node
        last, _ = doubled(inner.join(inner.select(F.col("node").alias("next")), "next", "left_semi").select("node", "next"))
        named = last.select("node", F.col("next").alias("name"))
        place = lambda df, column: df.join(named.toDF(column, "name"), column, "left").withColumn(column, F.coalesce("name", column)).drop("name")
        short = place(place(links, "node"), "next").where("node <> next").select("node", "next").distinct()
        ways = make_links(with_ends(short))
        heavy = stage(place(weights, "node").groupBy("node").agg(*[F.sum(c).alias(c) for c in names]), "run_weights")
        parts, turns = [], -(-count // roots_at_once)
        for turn in range(turns):
            some = sought.where(F.pmod("turn", F.lit(turns)) == turn).select("root")
            pairs, tables = closure(some, ways)
            sums = pairs.select("root", "node").join(heavy, "node").groupBy(F.col("root").alias("node")).agg(*[F.sum(c).alias(c) for c in names])
            parts.append(stage(sums, "reach"))
            unstage(*tables)
        totals = union(parts)
    else:
        totals = weights.where(F.lit(False))
    more = totals.select(F.col("node").alias("_at"), *[F.col(c).alias(f"_{c}") for c in names])
    out = mine.withColumn("_at", F.coalesce("end", "node")).join(more, "_at", "left")
    out = out.where(F.col("end").isNotNull() | F.col(f"_{names[0]}").isNotNull())
    return stage(out.select("node", *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names]), "reach_counts")


def capped_reach(links: DataFrame, roots: DataFrame, most: int, heavy: DataFrame | None = None) -> DataFrame:
    """(node, reach): number of nodes each root (column ``node``) reaches over one or more distinct ``links``, counted up to ``most``.

    ``heavy``: (node, weight) of nodes that count more than once.

    A node with ``most`` links settles every root that gets to it. The others add fewer than ``most`` rows for a root that has
    fewer than ``most`` of them, and each round adds a node to every root that is not settled: at most ``most`` rounds, whose
    rows per root are bounded whatever the graph. Roots that reach nothing are left out.
    """
    fan = stage(links.groupBy("node").agg(F.count("*").alias("fan")), "fan")
    mine = roots.select("node").distinct().join(fan, "node")
    done = [mine.where(F.col("fan") >= most).select("node", F.lit(most).alias("reach"))]
    ahead = fan.withColumnRenamed("node", "next")
    narrow = links.join(fan.where(F.col("fan") < most), "node", "left_semi").join(ahead, "next", "left").select("node", "next", F.coalesce("fan", F.lit(0)).alias("fan"))
    narrow = stage(narrow, "narrow")
    first = mine.where(F.col("fan") < most).select("node").join(narrow, "node")
    near = stage(first.select(F.col("node").alias("root"), F.col("next").alias("node"), "fan", F.lit(True).alias("new")), "near")
    while True:
        weighed = near.withColumn("weight", F.lit(1)) if heavy is None else near.join(heavy, "node", "left").na.fill(1, ["weight"])
        sums = stage(weighed.groupBy("root").agg(
            F.sum("weight").alias("n"), F.max("fan").alias("widest"), F.max(F.when(F.col("new"), F.col("fan")).otherwise(0)).alias("ahead")), "reach_sums")
        full = (F.col("n") >= most) | (F.col("widest") >= most)
        done.append(sums.where(full | (F.col("ahead") == 0)).select(F.col("root").alias("node"), F.when(full, F.lit(most)).otherwise(F.col("n")).alias("reach")))
        open_ = sums.where(~full & (F.col("ahead") > 0)).select("root")
        if open_.isEmpty():
            return union([d.select("node", F.col("reach").cast("long").alias("reach")) for d in done])
        before, near = near, near.join(open_, "root", "left_semi")
        steps = near.where("new AND fan > 0").select("root", "node").join(narrow.select("node", "next", F.col("fan").alias("more")), "node")
        found = steps.select("root", F.col("next").alias("node"), F.col("more").alias("fan")).distinct().join(near.select("root", "node"), ["root", "node"], "left_anti")
        near = stage(near.withColumn("new", F.lit(False)).unionByName(found.select("root", "node", "fan", F.lit(True).alias("new"))), "near")
        unstage(before)
