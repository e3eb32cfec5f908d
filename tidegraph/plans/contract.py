"""Shrinking a directed graph before its cycles are searched or its reach is counted.

Two steps alternate, as in parallel tree contraction: nodes without a predecessor or without a successor cannot lie on a
cycle and go; a run of nodes with one predecessor and one successor each becomes a single link between its ends. A run
is crossed by pointer doubling, so its length costs a logarithm of rounds, and trees and chains of any depth shrink by a
constant share in each turn. What is left has branches both ways everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.session import stage, unstage


def doubled(steps: DataFrame, carried: dict[str, Callable[[Column, Column], Column]] | None = None) -> tuple[DataFrame, int]:
    """Follow unique successors to their ends; the staged rows and the number of rounds.

    ``steps``: (node, next) with each node once, and columns that two consecutive stretches combine by ``carried``. In the
    result ``next`` is the first node on the way that has no step, and ``open`` is false; on a ring ``open`` stays true, and
    what is carried covers the whole ring at least once. A row of ``n`` nodes takes log2(n) + 1 rounds.
    """
    carried = carried or {}
    starts = steps.select(F.col("node").alias("next"), F.lit(True).alias("open"))
    rows = stage(steps.join(starts, "next", "left").select("node", "next", F.coalesce("open", F.lit(False)).alias("open"), *carried), "steps")
    size, waiting = rows.agg(F.count("*"), F.count_if("open")).first()
    rounds, reach = 0, 1
    while waiting and reach <= size:
        # a closed row is at its end; only open ones take the stretch of the row they point at
        there = rows.select(F.col("node").alias("next"), F.col("next").alias("further"), F.col("open").alias("goes_on"), *[F.col(c).alias(f"more_{c}") for c in carried])
        moved = rows.where("open").join(there, "next").select(
            "node", F.col("further").alias("next"), F.col("goes_on").alias("open"), *[how(F.col(c), F.col(f"more_{c}")).alias(c) for c, how in carried.items()])
        before, rows = rows, stage(rows.where("NOT open").unionByName(moved), "steps")
        unstage(before)
        waiting = rows.agg(F.count_if("open")).first()[0]
        rounds, reach = rounds + 1, 2 * reach
    return rows, rounds


@dataclass
class Shrunk:
    """``links`` that are left; ``runs`` (node, start, end): nodes of runs that became a link start-end; ``rings`` (node, component):
    nodes of cycles without a branch; ``loops`` (node): ends of runs that lead back to where they began; the number of rounds."""

    links: DataFrame
    runs: DataFrame | None
    rings: DataFrame | None
    loops: DataFrame | None
    rounds: int


def raked(links: DataFrame) -> DataFrame:
    """Links whose first node has a predecessor and whose second one has a successor."""
    entered = links.select(F.col("next").alias("node")).distinct()
    left = links.select(F.col("node").alias("next")).distinct()
    return stage(links.join(entered, "node", "left_semi").join(left, "next", "left_semi").select("node", "next"), "raked")


def _inner(links: DataFrame) -> DataFrame:
    """(node, next, before) of the nodes with one successor and one predecessor."""
    one = F.col("n") == 1
    after = links.groupBy("node").agg(F.count("*").alias("n"), F.min("next").alias("next")).where(one).drop("n")
    before = links.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("n"), F.min("node").alias("before")).where(one).drop("n")
    return stage(after.join(before, "node"), "inner")


def compressed(links: DataFrame) -> Shrunk:
    """One turn of replacing runs by links; ``links`` are distinct, without loops."""
    inner = _inner(links)
    if inner.isEmpty():
        return Shrunk(links, None, None, None, 0)
    ahead, rounds = doubled(inner.select("node", "next", F.col("node").alias("least")), {"least": F.least})
    back, _ = doubled(inner.select("node", F.col("before").alias("next")))
    runs = ahead.where("NOT open").select("node", F.col("next").alias("end")).join(back.where("NOT open").select("node", F.col("next").alias("start")), "node")
    runs = stage(runs.select("node", "start", "end"), "runs")
    rings = stage(ahead.where("open").select("node", F.col("least").alias("component")), "rings")
    ends = runs.select("start", "end").distinct()
    loops = stage(ends.where("start = end").select(F.col("start").alias("node")), "loops")
    rest = links.join(inner.select("node"), "node", "left_anti").join(inner.select(F.col("node").alias("next")), "next", "left_anti").select("node", "next")
    rest = stage(rest.union(ends.where("start <> end").select(F.col("start").alias("node"), F.col("end").alias("next"))).distinct(), "compressed")
    unstage(inner, ahead, back)
    return Shrunk(rest, runs, rings, loops, rounds)


def shrunk(links: DataFrame) -> tuple[DataFrame, list[Shrunk], int]:
    """The links that neither step removes any more, the turns that replaced runs, in their order, and the number of rounds."""
    rows = stage(links.select("node", "next").where(F.col("node") != F.col("next")).distinct(), "links")
    size, turns, rounds = rows.count(), [], 0
    while size:
        before, rows = rows, raked(rows)
        kept, rounds = rows.count(), rounds + 1
        unstage(before)
        if kept and kept == size:
            turn = compressed(rows)
            rounds += turn.rounds + 1
            if turn.runs is None:
                break
            unstage(rows)
            turns.append(turn)
            rows, kept = turn.links, turn.links.count()
        elif kept > size // 2:  # a slow rake is helped by a turn of the other step
            turn = compressed(rows)
            rounds += turn.rounds + 1
            if turn.runs is not None:
                unstage(rows)
                turns.append(turn)
                rows, kept = turn.links, turn.links.count()
        size = kept
    return rows, turns, rounds
