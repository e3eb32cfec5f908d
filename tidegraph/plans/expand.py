"""Level-by-level graph expansion.

Every round joins the newly found rows with the links, drops what was seen, and stages the rest. A
node with very many links is split: its links are spread over slices and only the frontier rows of
such nodes are repeated, once per slice. The list of split nodes is bounded by ``SPLIT_SHARE``
whatever the graph's size, hence safe to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.session import stage

SPLIT_SHARE = 2048      # a node with more than 1/2048 of all links is split: at most 2048 such nodes
SPLIT_ROWS = 200_000    # ... but never below this many links
MERGE_EVERY = 12        # rounds after which the seen tables are rewritten as one
TAIL = 8                # a round is a tail round when it found less than an eighth of everything seen
CLOSE, FULL = 12, 2_000_000  # rounds and pairs after which a search from a few roots is given up
SMALL = 50_000          # rows that are not worth an extra stage


@dataclass
class Links:
    """Directed links (``node``, ``next``, further columns), hot nodes cut into slices."""

    rows: DataFrame
    hubs: DataFrame | None
    size: int

    def expand(self, frontier: DataFrame, on: str = "node") -> DataFrame:
        """Join frontier rows (column ``on``) with their links."""
        if self.hubs is None:
            return frontier.join(self.rows.withColumnRenamed("node", on), on)
        cut = frontier.join(F.broadcast(self.hubs.withColumnRenamed("node", on)), on, "left")
        cut = cut.withColumn(
            "_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
        ).drop("_slices")
        return cut.join(self.rows.withColumnRenamed("node", on), [on, "_slice"]).drop("_slice")


def make_links(rows: DataFrame, split_rows: int = SPLIT_ROWS) -> Links:
    """Stage links, finding the nodes whose links have to be split."""
    rows = stage(rows, "links")
    total = rows.count()
    bound = max(split_rows, total // SPLIT_SHARE)
    if total <= bound:
        return Links(rows, None, total)
    hubs = (
        rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > bound)
        .select("node", F.ceil(F.col("n") / bound).cast("int").alias("_slices"))
    )
    hubs = stage(hubs, "hubs")
    if hubs.isEmpty():
        return Links(rows, None, total)
    cut = (
        rows.join(F.broadcast(hubs), "node", "left")
        .withColumn("_slice", F.pmod(F.xxhash64("next"), F.coalesce(F.col("_slices"), F.lit(1))).cast("int"))
        .drop("_slices")
    )
    return Links(stage(cut, "sliced_links"), hubs, total)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Seen:
    """Rows found so far, as the staged tables of the rounds."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.parts: list[DataFrame] = []
        self.size = 0
        self.last = 0

    def add(self, rows: DataFrame) -> int:
        self.last = rows.count()
        self.size += self.last
        self.parts.append(rows)
        if len(self.parts) > MERGE_EVERY:
            self.parts = [stage(union(self.parts), "seen")]
        return self.last

    def without(self, rows: DataFrame) -> DataFrame:
        """Rows not seen yet.

        In a tail round the candidates are few: they are staged, and only the seen rows among them
        take part, so that a long tail of rounds does not shuffle everything seen again.
        """
        seen = self.all().select(*self.keys)
        if self.size > SMALL and self.last * TAIL < self.size:
            rows = stage(rows, "candidates")
            seen = seen.join(rows.select(*self.keys), self.keys, "left_semi")
        return rows.join(seen, self.keys, "left_anti")

    def all(self) -> DataFrame:
        return union(self.parts)


def reached(start: DataFrame, links: Links) -> DataFrame:
    """Nodes reachable from the start nodes (column ``node``), those included.

    Two steps per round where all links together are few, as a round then costs more than its rows.
    """
    frontier = stage(start.select("node").distinct(), "reached")
    seen = Seen(["node"])
    while seen.add(frontier):
        steps, step = [], frontier
        for _ in range(2 if links.size <= SMALL else 1):
            step = links.expand(step.select("node")).select(F.col("next").alias("node"))
            steps.append(step)
        frontier = stage(seen.without(union(steps).distinct()), "reached")
    return seen.all()


def with_ends(links: DataFrame) -> DataFrame:
    """Links with ``open``: the next node has links of its own. Rows that end need not be expanded."""
    starts = links.select(F.col("node").alias("next")).distinct().withColumn("open", F.lit(True))
    return links.join(starts, "next", "left").select("node", "next", F.coalesce("open", F.lit(False)).alias("open"))


def closure(roots: DataFrame, ways: Links, depth: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Reachable pairs (``root``, ``node``, ``depth``) over one or more links, all roots at once; and the staged tables they are in.

    A root on a cycle reaches itself. ``roots`` has one column, ``root``; ``ways`` are links with ``open`` (``with_ends``).
    """
    frontier = roots.select("root", F.col("root").alias("node"))
    seen = Seen(["root", "node"])
    level = 0
    while depth is None or level < depth:
        level += 1
        found = ways.expand(frontier).select("root", F.col("next").alias("node"), "open").distinct()
        if seen.parts:
            found = seen.without(found)
        fresh = stage(found.withColumn("depth", F.lit(level)), "pairs")
        if seen.add(fresh) == 0:
            break
        frontier = fresh.where("open").select("root", "node")
        if frontier.isEmpty():
            break
    return seen.all().drop("open"), seen.parts


def small_closure(roots: DataFrame, ways: Links) -> DataFrame | None:
    """Reachable pairs (``root``, ``node``) over one or more links from a few roots; None if they are too many or too far apart."""
    frontier = roots.select("root", F.col("root").alias("node"))
    seen = Seen(["root", "node"])
    for _ in range(CLOSE):
        found = ways.expand(frontier).select("root", F.col("next").alias("node"), "open").distinct()
        fresh = stage(seen.without(found) if seen.parts else found, "pairs")
        if seen.add(fresh) == 0 or seen.size > FULL:
            break
        frontier = fresh.where("open").select("root", "node")
    return seen.all().select("root", "node") if seen.last == 0 else None
